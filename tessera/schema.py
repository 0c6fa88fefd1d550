"""Explicit schemas of the catalog and its companions; nothing is inferred from data."""

from __future__ import annotations

ELIGIBILITY_ARRAYS = ("countries", "states", "grades", "degreeLevels", "fields", "citizenship", "tags", "other")
REQUIREMENTS = ("essay", "needBased", "meritBased", "fee")

_STRINGS = "array<string>"
ELIGIBILITY = f"struct<{','.join(f'{a}:{_STRINGS}' for a in ELIGIBILITY_ARRAYS)},minimumGpa:double,minimumAge:double>"
AWARD = "struct<minimum:double,maximum:double,varies:boolean>"
REQUIRED = f"struct<{','.join(f'{r}:boolean' for r in REQUIREMENTS)}>"
VETTING = "struct<status:string,vettedAt:string,vettedBy:string,confidence:double,method:string,checkedUrl:string,missingFields:array<string>>"

def _ddl(text: str) -> str:
    return " ".join(text.split())


#: A record as its source writes it.
RAW_DDL = _ddl(
    f"""id string, title string, provider string, sourceName string, sourceUrl string, sourceUrls {_STRINGS}, sourceCheckedAt string,
    sourceMissingFields {_STRINGS}, applicationUrl string, opens string, deadline string, deadlineType string, programStatus string,
    summary string, description string, award {AWARD}, requirements {REQUIRED}, eligibility {ELIGIBILITY}, tags {_STRINGS},
    institutionSpecific boolean, institutionName string, institutionTypes {_STRINGS}, vetting {VETTING}"""
)
#: An enrichment: some verified fields of one record, applied in file order.
ENRICHMENT_DDL = _ddl(
    f"""id string, pipelineVersion int, mode string, verifiedFields {_STRINGS}, description string, award {AWARD},
    requirements {REQUIRED}, eligibility {ELIGIBILITY}, enrichedFromUrl string, enrichedAt string"""
)
#: A tag overlay; a piece of evidence is kept as the JSON text it is written in.
OVERLAY_DDL = _ddl(f"id string, mode string, pipelineVersion int, taxonomyVersion int, tags {_STRINGS}, evidence {_STRINGS}, taggedAt string, model string")
#: A record as it is published.
PUBLISHED_DDL = _ddl(
    f"""id string, title string, provider string, source_name string, source_url string, source_urls {_STRINGS}, source_checked_at date,
    source_missing_fields {_STRINGS}, application_url string, opens date, deadline date, description string, award {AWARD},
    requirements {REQUIRED}, eligibility {ELIGIBILITY}, institution_specific boolean, institution_name string,
    institution_types {_STRINGS}, search_text string, vetting {VETTING}, publication_status string, published_at timestamp, updated_at timestamp"""
)
REPORT_DDL = "id string, scholarship_id string, issue string, status string, created_at timestamp"
CONTRIBUTION_DDL = _ddl(
    """id string, scholarship_id string, scholarship_title string, provider string, contributor_name string, relationship string, deadline date,
    award_amount decimal(12,2), minimum_gpa decimal(3,2), maximum_income decimal(12,2), location string, grade string, degree_level string,
    field_of_study string, citizenship string, essay_required boolean, recommendations_required boolean, need_based boolean, merit_based boolean,
    fee_required boolean, application_requirements string, application_url string, source_name string, source_url string, notes string,
    status string, review_notes string, created_at timestamp, reviewed_at timestamp"""
)
