"""Normalisation, folding, grouping, pruning, editing, searching and the build, on small catalogs."""

from __future__ import annotations

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.functions import fts
from tessera.operators import dedupe, edit, facets, lookup, normalize, overlay, projection, prune, search, validate
from tessera.plans import build as plan
from tessera.schema import CONTRIBUTION_DDL, ENRICHMENT_DDL, OVERLAY_DDL, PUBLISHED_DDL, RAW_DDL
from tessera.sources import catalog, sinks
from tessera.streaming import projection as stream

TODAY = "2026-07-16"


def raw(i, **more):
    base = {
        "id": f"s{i}", "title": f"Prize {i} of the Town", "provider": "Town", "sourceName": "Src", "sourceUrl": f"https://town.example.org/{i}", "sourceCheckedAt": "2026-01-01",
        "applicationUrl": f"https://apply.example.org/{i}", "opens": None, "deadline": None, "description": "", "award": {"maximum": None, "varies": False}, "requirements": {},
        "eligibility": {"countries": ["United States"], "states": ["Colorado"], "grades": ["12th Grade"], "degreeLevels": [], "fields": [], "tags": ["veteran"], "other": [], "citizenship": []},
    }
    return {**base, **more}


def frame(spark, records, ddl=RAW_DDL):
    schema = spark.createDataFrame([], f"seq long, {ddl}").schema
    text = spark.createDataFrame([(json.dumps({"seq": i, **r}),) for i, r in enumerate(records)], "v string")
    parsed = [r["r"] for r in text.select(F.from_json("v", schema).alias("r")).collect()]
    return spark.createDataFrame(parsed, schema)


def test_candidates(spark):
    bad = raw(2, applicationUrl="javascript:alert(1)", deadline="soon")
    local = raw(3, applicationUrl="http://127.0.0.1/admin", award={"maximum": -1.0, "varies": False})
    rows = {r["id"]: r for r in normalize.prepare_candidates(frame(spark, [raw(1), bad, local, {"title": "x"}])).collect()}
    one = rows["s1"]
    assert one["eligibility"]["countries"] == ["US"] and one["eligibility"]["states"] == ["CO"] and one["eligibility"]["grades"] == ["High School Senior"]
    assert one["errors"] == [] and one["qualityFlags"] == ["missing:deadline", "missing:award", "missing:degree_levels", "missing:description", "human_review_required"]
    assert rows["s2"]["errors"] == ["invalid_applicationUrl", "invalid_deadline"] and rows["s3"]["errors"] == ["invalid_applicationUrl", "invalid_award"]
    assert "missing_id" in rows[None]["errors"] and one["normalizedFingerprint"] != rows["s2"]["normalizedFingerprint"]


def test_evidence(spark):
    given_ = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(e, ("fieldPath", "evidenceText", "extractionMethod", "confidence")))) for e in (("a", "x" * 3000, "", "0.4"), ("", "y", "m", "2"))))
    found = normalize.prepare_candidates(frame(spark, [raw(1)]), evidence=given_).first()["evidence"]
    assert len(found) == 1 and len(found[0]["evidenceText"]) == 2000 and found[0]["extractionMethod"] == "source_adapter" and found[0]["confidence"] == 0.4


def test_greedy_fold_replays_order(spark):
    rows = spark.createDataFrame([(i, k[0], k[1], f"u{i}", None) for i, k in enumerate(["aX", "aY", "cY", "dX", "eZ", "eZ"])], "seq long, id string, mark string, sourceUrl string, sourceUrls array<string>")
    kept = {r["id"]: r["sourceUrls"] for r in dedupe.greedy_dedupe(rows, fingerprint=F.col("mark")).collect()}
    assert kept == {"a": ["u0", "u1", "u3"], "c": ["u2"], "e": ["u4", "u5"]}


def test_greedy_fold_by_brute_force(spark):
    """A hundred folds at once: keys of each have its number before them, so they share none."""
    rng, rows, want = random.Random(7), [], {}
    for n in range(100):
        by_id, by_mark = {}, {}
        for _ in range(rng.randint(1, 25)):
            i, a, b = len(rows), rng.choice(["", *"abcdefgh"]), rng.choice(["", *"VWXYZ"])
            a, b = (a and f"{n}{a}"), (b and f"{n}{b}") or f"{n}-"
            a = a or f"{n}."
            kept = by_id.get(a, by_mark.get(b))
            if kept is None:
                kept = by_id[a] = by_mark[b] = i
            want.setdefault(kept, []).append(f"u{i}")
            rows.append((i, a, b, f"u{i}", None))
    frame_ = spark.createDataFrame(rows, "seq long, id string, mark string, sourceUrl string, sourceUrls array<string>").repartition(5)
    assert {r["seq"]: r["sourceUrls"] for r in dedupe.greedy_dedupe(frame_, fingerprint=F.col("mark")).collect()} == want


def test_null_keys_are_one_key(spark):
    rows = spark.createDataFrame([(0, None, "x", "u0", None), (1, None, "y", "u1", None), (2, "a", None, "u2", None), (3, "b", None, "u3", ["v"])], "seq long, id string, mark string, sourceUrl string, sourceUrls array<string>")
    assert {r["seq"]: r["sourceUrls"] for r in dedupe.greedy_dedupe(rows, fingerprint=F.col("mark")).collect()} == {0: ["u0", "u1"], 2: ["u2", "u3"]}
    assert dedupe.greedy_dedupe(rows.limit(0), fingerprint=F.col("mark")).count() == 0


def test_only_records_with_an_overlay_are_normalised_again(spark):
    base = normalize.normalize(frame(spark, [raw(i, eligibility={**raw(i)["eligibility"], "tags": ["Future Teacher"]}) for i in (1, 2)]))
    assert [r["eligibility"]["tags"] for r in base.collect()] == [["future-teachers"]] * 2
    none = frame(spark, [], ENRICHMENT_DDL)
    once = overlay.enrich(base, none, ["stem"])
    assert [r["eligibility"]["tags"] for r in once.collect()] == [["future-teachers"]] * 2
    tags = frame(spark, [{"id": "s2", "mode": "replace", "pipelineVersion": 6, "taxonomyVersion": 4, "tags": ["stem"], "evidence": ["because"], "taggedAt": "t", "model": "m"}], OVERLAY_DDL)
    done = {r["id"]: r for r in overlay.overlay_tags(once, tags, ["stem"], 4).collect()}
    assert done["s1"]["eligibility"]["tags"] == ["future-teachers"] and done["s1"]["tagEvidence"] is None
    assert done["s2"]["eligibility"]["tags"] == ["stem"] and done["s2"]["tagEvidence"] == ["because"] and done["s2"]["taggedByModel"] == "m"
    step = {"id": "s1", "pipelineVersion": 2, "verifiedFields": ["eligibility.tags"], "eligibility": {"tags": ["education"]}}
    # An enriched record hops once: the taxonomy has both, so "future-teachers" becomes "education".
    assert {r["id"]: r["eligibility"]["tags"] for r in overlay.enrich(base, frame(spark, [step], ENRICHMENT_DDL), ["future-teachers", "education"]).collect()} == {"s1": ["education"], "s2": ["future-teachers"]}


def test_enrichments_fold_in_order(spark):
    base = normalize.normalize(frame(spark, [raw(1), raw(2, description="own", award={"maximum": 5.0, "varies": False})]))
    steps = [
        {"id": "s1", "pipelineVersion": 2, "mode": "fill", "verifiedFields": ["description", "eligibility.tags"], "description": "first", "eligibility": {"tags": ["stem", "nope"]}},
        {"id": "s1", "pipelineVersion": 3, "mode": "fill", "verifiedFields": ["description"], "description": "second"},
        {"id": "s2", "pipelineVersion": 3, "mode": "replace", "verifiedFields": ["description", "award.maximum"], "description": "new", "award": {"maximum": 9.0}},
        {"id": "s2", "pipelineVersion": 1, "mode": "replace", "verifiedFields": ["description"], "description": "too old"},
        {"id": "s2", "pipelineVersion": 3, "mode": "replace", "verifiedFields": ["award.maximum"], "description": "not verified"},
    ]
    done = {r["id"]: r for r in overlay.enrich(base, frame(spark, steps, ENRICHMENT_DDL), ["stem", "women"]).collect()}
    assert done["s1"]["description"] == "first" and done["s1"]["eligibility"]["tags"] == ["stem"] and done["s1"]["enrichedCanonicalTags"] == ["stem"]
    assert done["s2"]["description"] == "new" and done["s2"]["award"]["maximum"] == 9.0
    tagged = overlay.overlay_tags(
        overlay.enrich(base, frame(spark, steps, ENRICHMENT_DDL), ["stem", "women"]),
        frame(spark, [{"id": "s1", "mode": "replace", "pipelineVersion": 6, "taxonomyVersion": v, "tags": t} for v, t in ((4, ["nope"]), (4, ["women"]), (3, ["stem"]))], OVERLAY_DDL),
        ["stem", "women"],
        4,
    )
    assert {r["id"]: r["eligibility"]["tags"] for r in tagged.collect()} == {"s1": ["women", "stem"], "s2": []}


def test_groups_partition_the_input(spark):
    records = [raw(1, title="Gold Prize 2024", deadline="2026-01-01"), raw(2, title="Gold Prize 2025", deadline="2027-01-01"), raw(3, title="gold prize", deadline=None), raw(4, title="Other Thing")]
    rows = {r["id"]: r for r in dedupe.group_similar(frame(spark, records), TODAY).collect()}
    assert set(rows) == {"s2", "s4"} and rows["s2"]["variantIds"] == ["s2", "s3", "s1"] and rows["s2"]["variantCount"] == 3
    assert rows["s4"]["variantIds"] is None and rows["s2"]["sourceUrls"] == [f"https://town.example.org/{i}" for i in (2, 3, 1)]


def record(i, **more):
    base = {
        "id": f"p{i}", "title": f"Title {i}", "provider": "Prov", "source_name": "Src", "source_url": f"https://src.example.org/{i}", "source_urls": [f"https://src.example.org/{i}"], "source_checked_at": "2026-01-01",
        "application_url": f"https://app.example.org/{i}", "deadline": None, "description": "d", "award": {"maximum": 10.0}, "requirements": {"essay": True}, "eligibility": {"tags": ["stem"], "grades": ["Grade 3"]},
        "institution_specific": False, "institution_types": [], "search_text": f"title {i} engineering", "vetting": {"status": "ai"}, "publication_status": "published", "updated_at": "2026-01-01T00:00:00Z",
    }
    return {**base, **more}


def test_pruning_keeps_the_complete_record(spark):
    records = [
        record(1, title="Acme Science Scholarship", provider="Acme"),
        record(2, title="Science Award 2026", provider="ACME", deadline="2027-01-01", description="long " * 30, vetting={"status": "human"}),
        record(3, title="Acme Arts Fund", provider="Acme", vetting={"status": "human"}),
        record(4, title="Arts", provider="Acme", vetting={"status": "human"}),
        record(5, title="Lonely Thing"),
    ]
    rows = frame(spark, records, PUBLISHED_DDL)
    plans, skipped = prune.plan(rows, TODAY)
    (one,) = plans.collect()
    assert (one["survivor_id"], one["duplicate_ids"], one["source_urls"]) == ("p2", ["p1"], ["https://src.example.org/1", "https://src.example.org/2"])
    assert [r["ids"] for r in skipped.collect()] == [["p3", "p4"]]
    assert prune.plan(rows, TODAY, title="science award", keep="p1")[0].first()["survivor_id"] == "p1" and prune.plan(rows, TODAY, title="nothing here")[0].count() == 0
    assert prune.summarize(plans, rows).first()["delete"][0]["id"] == "p1"
    reports = spark.createDataFrame([("r1", "p1"), ("r2", "p5")], "id string, scholarship_id string")
    left, moved, _, result = prune.apply(rows, reports, reports, plans, F.current_timestamp())
    assert {r["id"] for r in left.collect()} == {"p2", "p3", "p4", "p5"} and {r["scholarship_id"] for r in moved.collect()} == {"p2", "p5"}
    assert result.first()["deleted"] == 1 and left.where("id = 'p2'").first()["source_urls"] == one["source_urls"]
    broken = spark.createDataFrame([("k", "p2", ["gone"], [])], "key string, survivor_id string, duplicate_ids array<string>, source_urls array<string>")
    with pytest.raises(Exception, match="doesn't exist"):
        prune.checked(broken, rows).collect()


def test_prune_options():
    assert prune.parse_options(["--title", "x", "--yes"]).yes
    for wrong in (["--yes"], ["--keep", "a"], ["--title"], ["--what"]):
        with pytest.raises(ValueError):
            prune.parse_options(wrong)


def test_pages_concatenate(spark):
    records = [record(i, deadline=[None, "2026-09-01", "2026-08-01"][i % 3]) for i in range(11)]
    table = frame(spark, records, PUBLISHED_DDL)
    whole = [r["id"] for r in search.search_published(table, search.SearchQuery(TODAY, limit=100)).collect()]
    cursor, seen = None, []
    while True:
        page = search.response(table, search.SearchQuery(TODAY, limit=4, cursor=cursor))
        seen += [r["id"] for r in page["records"]]
        cursor = page["nextCursor"]
        assert page["total"] == (11 if len(seen) <= 4 else 0)
        if not page["hasMore"]:
            break
    assert seen == whole and len(seen) == 11


def test_search_filters(spark):
    table = frame(spark, [record(1), record(2, award={"maximum": None}, deadline="2026-01-01"), record(3, publication_status="draft")], PUBLISHED_DDL)
    from tessera.functions import fts

    table = table.withColumn("search_document", fts.analyse("search_text"))
    ids = lambda **q: [r["id"] for r in search.search_published(table, search.SearchQuery(TODAY, **q)).collect()]
    assert ids() == ["p1"] and ids(include_closed=True) == ["p2", "p1"] and ids(include_closed=True, minimum_award=1) == ["p1"]
    assert ids(q="engineers") == ["p1"] and ids(q="painters") == [] and ids(grade="K-8") == [] and ids(grade="Grade 3") == ["p1"] and ids(scope="institution") == []
    assert search.expand_grades("K-8")[0] == "Kindergarten" and search.expand_grades("10th grade") == ["High School Sophomore"]


def test_parameters():
    q = search.parse_query({"q": "  a   b ", "tag": "Low Income", "state": "colorado", "minimumAward": "-5", "page": "x", "asOfDate": "never"}, TODAY)
    assert (q.q, q.tag, q.state, q.minimum_award, q.page, q.limit, q.as_of) == ("a b", "financial-need", "CO", 0, 1, 1, TODAY)
    assert search.decode_cursor(search.encode_cursor(date(2026, 1, 2), "é")) == ("2026-01-02", "é") and search.decode_cursor("%%") is None
    assert search.refuse_bulk({"all": "true"}) == 410 and search.refuse_bulk({}, False) == 503 and search.refuse_bulk({}) is None


def test_editing():
    one = record(1)
    after, changed = edit.edited(one, ["title=New", "eligibility.tags=a | b", "award.maximum=5.5"], vetter="Kim", now="2026-02-03T00:00:00")
    assert after["eligibility"]["tags"] == ["a", "b"] and after["award"]["maximum"] == 5.5 and after["vetting"]["status"] == "human" and one["title"] == "Title 1"
    assert set(changed) == {"title", "eligibility", "award", "vetting", "source_checked_at", "source_missing_fields", "search_text"} and changed["search_text"].startswith("new prov d")
    for wrong in ("id=x", "__proto__.a=1", "title", "title.__proto__=1", "source_url=ftp://x", "publication_status=gone"):
        with pytest.raises(ValueError):
            edit.edited(record(1), [wrong])


def test_vetting_and_addresses():
    after, changed = edit.edited(record(1), ["source_url=https://new.example.org/"], vetter="Kim", now="2026-02-03T00:00:00")
    assert after["source_urls"] == ["https://new.example.org/", "https://src.example.org/1"] and "source_urls" in changed
    assert after["vetting"] == {**after["vetting"], "status": "human", "vettedBy": "Kim", "method": "manual-review", "checkedUrl": "https://new.example.org/", "confidence": 1.0, "missingFields": []}


def test_one_record_is_changed(spark):
    rows = frame(spark, [record(1), record(2, title="Two"), record(2, id="p3", title="two")], PUBLISHED_DDL)
    assert lookup.find_one(rows, "p1")["id"] == "p1" and lookup.find_one(rows, "TITLE 1")["id"] == "p1"
    for wrong in ("nothing like it", "TWO"):
        with pytest.raises(ValueError):
            lookup.find_one(rows, wrong)
    stamp = edit.vet_stamp("Kim", F.lit("2026-02-03 01:02:03").cast("timestamp"))
    (only,) = edit.update_one(rows, "p1", stamp).collect()
    assert only["vetting"]["checkedUrl"] == "https://src.example.org/1" and only["vetting"]["vettedBy"] == "Kim" and str(only["source_checked_at"]) == "2026-02-03"
    assert edit.update_one(rows, "p1", stamp, yes=True).count() == 3
    with pytest.raises(ValueError):
        edit.update_one(rows, "p9", stamp)


def test_a_scan_is_remembered_unless_it_fails(spark):
    calls = []

    def load():
        calls.append(1)
        return spark.range(3) if len(calls) > 1 else spark.range(3).selectExpr("raise_error('x') AS id")

    kept = catalog.Memoised(load)
    with pytest.raises(Exception):
        kept.get()
    assert kept.get().count() == kept.get().count() == 3 and len(calls) == 2


def test_a_database_table_in_ranges(spark):
    url, driver = "jdbc:derby:memory:records;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(100).selectExpr("id", "CAST(id AS STRING) AS title").write.jdbc(url, "records", "overwrite", driver)
    rows = catalog.paged_jdbc(spark, url, "records", "id", 0, 100, 5, driver)
    assert rows.rdd.getNumPartitions() == 5 and sorted(r[0] for r in rows.collect()) == list(range(100))


def test_every_match_passes_the_cheap_test(spark):
    words = sorted({w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'").collect() for w in r["text"].lower().split() if w.isalnum()})
    for w in [*words, "skies", "dying", "relational", "happily", "hoping", "ponies", "nationalization", "early", "news", "ties", "agreed", "sky"]:
        s = fts.stem(w)
        assert s[: max(1, len(s) - 2)] in w
    texts = spark.createDataFrame([("Happy licenses",), ("licensing happiness",), ("license",), ("none",)], "text string").withColumn("document", fts.analyse("text"))
    for q in ("happy license", '"license happy"', "happy or none", "-happy", "the"):
        found = texts.select(F.coalesce(fts.may_match(F.col("text"), q), F.lit(False)).alias("may"), fts.matches(F.col("document"), q).alias("is")).collect()
        assert all(r["may"] for r in found if r["is"])


def test_contributions(spark):
    good = {"id": "c", "scholarship_title": "T", "provider": "P", "relationship": "winner", "location": "L", "grade": "Grade 1", "citizenship": "DACA recipient", "source_name": "S", "source_url": "https://a.org/x", "status": "pending"}
    rows = frame(spark, [good, {**good, "grade": "Grade 99", "minimum_gpa": "6.00", "source_url": "x y"}, {**good, "source_url": None}, {**good, "scholarship_id": "p9"}, {**good, "scholarship_id": "p1"}], CONTRIBUTION_DDL)
    found = [r["e"] for r in rows.select("seq", validate.contribution_errors().alias("e")).orderBy("seq").collect()]
    assert found == [[], ["minimum_gpa", "grade", "source_url"], ["no_url"], [], []]
    kept = validate.contribution_submission(rows, frame(spark, [record(1), record(9, publication_status="draft")], PUBLISHED_DDL))
    assert sorted(r["seq"] for r in kept.collect()) == [0, 4]


def test_numbering_is_the_global_order(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    out = facets.numbered(rows.repartition(7), [F.col("v")]).collect()
    assert all(r["n"] == r["v"] + 1 for r in out) and len(out) == 1000


def test_projection_equals_recompute(spark):
    table = frame(spark, [record(i) for i in range(4)], PUBLISHED_DDL).drop("seq")
    changed = frame(spark, [record(0, title="N"), record(1, publication_status="archived"), record(7), record(2)], PUBLISHED_DDL).withColumn("op", F.when(F.col("id") == "p2", "D").otherwise("U"))
    after = projection.synchronise(projection.project(table), changed, [F.col("seq").desc()])
    assert sorted(r["id"] for r in after.collect()) == ["p0", "p3", "p7"]
    merged = projection.upsert(table, changed.where("op = 'U'").drop("op", "seq"))
    wanted = projection.project(merged.where("id <> 'p2'"))
    assert sorted(map(str, after.collect())) == sorted(map(str, wanted.select(*after.columns).collect()))


def test_stream(spark, tmp_path):
    folder = tmp_path / "changes"
    folder.mkdir()
    lines = [{"op": "I", "seq": 1, **record(1)}, {"op": "I", "seq": 2, **record(2)}, {"op": "D", "seq": 3, "id": "p1"}]
    (folder / "a.json").write_text("\n".join(map(json.dumps, lines)))
    for extra in (None, {"op": "U", "seq": 4, **record(3)}):
        if extra:
            (folder / "b.json").write_text(json.dumps(extra))
        stream.start(spark, str(folder), f"op string, seq long, {PUBLISHED_DDL}", f"{tmp_path}/projection", f"{tmp_path}/state").awaitTermination()
    assert sorted(r["id"] for r in stream.read(spark, f"{tmp_path}/projection").collect()) == ["p2", "p3"]


def test_a_batch_leaves_other_parts_alone(spark, tmp_path):
    path = f"{tmp_path}/projection"
    assert stream.read(spark, path).count() == 0
    batch = lambda rows: frame(spark, rows, f"op string, {PUBLISHED_DDL}")
    stream.apply_batch(batch([{"op": "I", **record(i)} for i in range(40)]), path, parts=8)
    before = sinks.parts_of(spark, path)
    stream.apply_batch(batch([{"op": "D", "id": "p3"}, {"op": "U", **record(4, title="N")}]), path)
    after = sinks.parts_of(spark, path)
    assert before["parts"] == after["parts"] == "8" and 1 <= sum(before[k] != after[k] for k in before) <= 2
    stream.apply_batch(batch([{"op": "D", "id": "p3"}, {"op": "U", **record(4, title="N")}]), path)
    assert sorted(r["id"] for r in stream.read(spark, path).collect()) == sorted(f"p{i}" for i in range(40) if i != 3)


def test_build(spark, tmp_path):
    (tmp_path / "base.json").write_text(json.dumps([raw(1, deadline="2026-01-01"), raw(2, deadline="2026-12-31", tags=None), raw(2, sourceUrl="https://other.example.org/2")]))
    deep = tmp_path / "imports" / "a"
    deep.mkdir(parents=True)
    (deep / "records.jsonl").write_text(json.dumps(raw(5, title="Imported Gold Prize")) + "\n\n")
    (tmp_path / "imports" / "records.jsonl").write_text(json.dumps(raw(6)))
    (tmp_path / "taxonomy.json").write_text(json.dumps({"version": 4, "tags": [{"id": "veteran"}, {"id": "stem"}]}))
    inputs = plan.Inputs(*(f"{tmp_path}/{n}" for n in ("base.json", "imports", "none.jsonl", "none.jsonl", "taxonomy.json")))
    figures = plan.build(spark, inputs, f"{tmp_path}/out", TODAY)
    assert (figures["count"], figures["directoryCount"], figures["activeDirectoryCount"]) == (3, 2, 2) and figures["facets"]["tags"] == ["veteran"]
    written = {r["id"]: r for r in sinks.read_table(spark, f"{tmp_path}/out/catalog").collect()}
    assert set(written) == {"s1", "s2", "s5"} and written["s2"]["sourceUrls"] == ["https://town.example.org/2", "https://other.example.org/2"]
    plan.publish(spark, f"{tmp_path}/out", f"{tmp_path}/table", "2026-07-16 00:00:00")
    plan.publish(spark, f"{tmp_path}/out", f"{tmp_path}/table", "2026-07-17 00:00:00")
    assert sinks.read_table(spark, f"{tmp_path}/table").count() == 3


def test_tables_change_at_once(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, path)
    sinks.replace_table(spark.range(3), path)
    old = sinks.read_table(spark, path)
    sinks.replace_table(sinks.read_table(spark, path).where("id > 0"), path)
    assert old.count() == 3 and sinks.read_table(spark, path).count() == 2
    for n in range(4):
        sinks.replace_table(spark.range(n), path)
    assert sum(f.name.startswith("v-") for f in (tmp_path / "table").iterdir()) == 2
    # A write that fails leaves the table as it is; a store that is busy is asked again.
    with pytest.raises(Exception):
        sinks.replace_table(spark.range(3).selectExpr("raise_error('x') AS v"), path)
    assert sinks.read_table(spark, path).count() == 3
    monkeypatch.setattr(sinks.time, "sleep", lambda s: waits.append(s))
    waits = []
    real, failures = sinks.json.dumps, iter([True, True, False])

    class Busy(str):
        def encode(self):
            if next(failures):
                raise OSError("busy")
            return str(self).encode()

    monkeypatch.setattr(sinks.json, "dumps", lambda x: Busy(real(x)))
    sinks.replace_table(spark.range(7), path)
    assert sinks.read_table(spark, path).count() == 7 and waits == [0.1, 0.2]


def test_json_array_by_parts(spark, tmp_path):
    """Records, texts and escapes across parts of the file, in order; a broken file fails."""
    texts = ["}{", 'say "x" }', "back\\\\", "[,]", "é}" * 30, ""]
    rows = [{"a": texts[i % 6] * (1 + i % 4), "b": {"c": i, "d": {"e": [{"f": "}"}]}}} for i in range(60)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    ddl = "a string, b struct<c:int,d:struct<e:array<struct<f:string>>>>"
    try:
        for size in ("64b", "333b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for indent in (None, 2):
                (tmp_path / "x.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
                found = catalog.json_array(spark, f"{tmp_path}/x.json", ddl).orderBy("seq").collect()
                assert [(r["a"], r["b"]["c"], r["b"]["d"]["e"][0]["f"]) for r in found] == [(r["a"], r["b"]["c"], "}") for r in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for text, right in (("[]", True), (" [ ]\n", True), ('[{"a": "x"}', False), ('{"a": "x"}', False), ('[{"a": "x"} {"a": "y"}]', False), ('[{"a": "x"}] 1', False)):
        (tmp_path / "y.json").write_text(text)
        if right:
            assert catalog.json_array(spark, f"{tmp_path}/y.json", ddl).count() == 0
        else:
            with pytest.raises(Exception):
                catalog.json_array(spark, f"{tmp_path}/y.json", ddl).collect()
