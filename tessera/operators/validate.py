"""Validation: rules are columns of error names, and a table falls into accepted and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import vocab

CANDIDATE_REQUIRED = ("id", "title", "provider", "sourceName", "sourceUrl", "applicationUrl")
CATALOG_REQUIRED = ("id", "title", "provider", "sourceUrl", "sourceCheckedAt")
DEGREES = ("Doctoral Degree", "Graduate Degree", "Bachelor's Degree", "Associate Degree", "1-year Certificate", "Professional Certification")
CITIZENSHIPS = (
    "DACA recipient",
    "International student eligible",
    "Other / not sure",
    "U.S. permanent resident",
    "U.S. citizen",
    "No citizenship requirement",
    "U.S. resident (citizenship not required)",
)
_URL = r"(?i)^https?://\S+$"


def errors(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that a row breaks, each once, in order."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), name) for broken, name in rules))))


def candidate_errors() -> Column:
    rules = [(S.text(c) == "", f"missing_{c}") for c in CANDIDATE_REQUIRED]
    for c in ("sourceUrl", "applicationUrl"):
        parsed = S.host(c)
        rules.append((parsed.isNull() | ~S.is_http(F.lower(S.text(c))) | S.private_host(c), f"invalid_{c}"))
    for c in ("opens", "deadline", "sourceCheckedAt"):
        rules.append(((S.text(c) != "") & ~S.text(c).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), f"invalid_{c}"))
    top = F.col("award.maximum")
    rules.append((F.isnan(top) | (top < 0) | (top == float("inf")), "invalid_award"))
    return errors(*rules)


def catalog_errors() -> Column:
    """What stops a catalog build: missing fields, or a source that isn't a public address."""
    return errors(*((S.text(c) == "", f"missing_{c}") for c in CATALOG_REQUIRED), (~S.is_http("sourceUrl"), "invalid_sourceUrl"))


def split(df: DataFrame, rules: Column, name: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with their errors)."""
    checked = df.withColumn(name, rules)
    return checked.where(F.size(name) == 0).drop(name), checked.where(F.size(name) > 0)


def required(df: DataFrame, rules: Column) -> DataFrame:
    """``df``, failing the query at the first row that breaks a rule."""
    message = F.concat(S.text("id"), F.lit(": "), F.array_join(rules, ", "))
    return df.where(F.when(F.size(rules) > 0, F.raise_error(message).cast("boolean")).otherwise(True))


def _long(c: str, least: int, most: int, optional: bool = True) -> Column:
    bad = ~F.length(F.trim(F.col(c))).between(least, most)
    return bad if optional else F.col(c).isNull() | bad


def report_errors() -> Column:
    return errors((F.col("scholarship_id").isNull(), "scholarship_id"), (_long("issue", 10, 1000, False), "issue"), (~F.col("status").isin("dismissed", "open", "resolved"), "status"))


def contribution_errors() -> Column:
    """Checks of a contribution's row: lengths, ranges, vocabularies, addresses, and one address at least."""
    url = lambda c: (F.length(c) > 2048) | ~F.col(c).rlike(_URL)
    member = lambda c, values, optional=False: ~F.col(c).isin(*values) if optional else F.col(c).isNull() | ~F.col(c).isin(*values)
    return errors(
        *((_long(c, 1, 200, False), c) for c in ("scholarship_title", "provider", "location", "source_name")),
        (_long("contributor_name", 1, 100), "contributor_name"),
        (member("relationship", ("finalist", "other", "winner")), "relationship"),
        *((~F.col(c).between(0, top), c) for c, top in (("award_amount", 100_000_000), ("minimum_gpa", 5), ("maximum_income", 100_000_000))),
        (member("grade", vocab.GRADES), "grade"),
        (member("degree_level", DEGREES, True), "degree_level"),
        (_long("field_of_study", 1, 200), "field_of_study"),
        (member("citizenship", CITIZENSHIPS), "citizenship"),
        *((_long(c, 1, 2000), c) for c in ("application_requirements", "notes", "review_notes")),
        *((url(c), c) for c in ("application_url", "source_url")),
        (member("status", ("applied", "pending", "rejected", "reviewed")), "status"),
        (F.col("application_url").isNull() & F.col("source_url").isNull(), "no_url"),
    )


def submission(reports: DataFrame, published: DataFrame) -> DataFrame:
    """Reports whose scholarship is published: what the public may add."""
    parents = published.where(F.col("publication_status") == "published").select(F.col("id").alias("scholarship_id"))
    return reports.where(F.size(report_errors()) == 0).join(parents, "scholarship_id", "left_semi")


def contribution_submission(contributions: DataFrame, published: DataFrame) -> DataFrame:
    """Pending contributions that name no scholarship, or a published one."""
    parents = published.where(F.col("publication_status") == "published").select(F.col("id").alias("scholarship_id"), F.lit(True).alias("parent_published")).distinct()
    valid = contributions.where((F.size(contribution_errors()) == 0) & (F.col("status") == "pending"))
    return valid.join(parents, "scholarship_id", "left").where(F.col("scholarship_id").isNull() | F.col("parent_published")).select(*contributions.columns)
