"""That the rows of each pN_found come by the problem's method: seen on the plans, and on what is left of them when the method's part is changed."""

import datetime

import pytest

import __spark_entry__
from corpusloom.llm import mixing, pieces, quality, residue

NOW = datetime.datetime(2024, 1, 1)
PROSE = "The mill of the town was closed in 1539, and it is not known who has the letters of the miller. "


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sf"))
    corpora = [("wiki", "xml", "page", None, None), ("papers", "xml", "article", None, None), ("discs", "xml", "release", None, None), ("json", "json", None, None, None), ("notes", "txt", None, 300, 20)]
    records = []
    for k in range(40):
        records.append((len(records), f"<page><title>T</title><text xml:space='preserve'>== Menu ==\n\n'''Page''' {k} is {PROSE}</text></page>".encode(), "wiki"))
        records.append((len(records), f"<release><title>t{k}</title><tracks><track><title>a</title><credit><name>n</name></credit></track><track><title>b</title><credit/></track></tracks></release>".encode(), "discs"))
        records.append((len(records), (PROSE * (1 + k % 5) + f"gizofo{k} " * 5).encode(), "notes"))
    records.append((len(records), b"a, b, c;\n" * 4, "notes"))
    rows = [(i, b, c, None, NOW) for i, b, c in records] + [(0, None, "wiki", None, NOW), (2, records[2][1], "notes", "again", NOW)]
    spark.createDataFrame(rows, "index bigint, bytes binary, corpus string, filename string, ingested_at timestamp").write.parquet(f"{base}/records.parquet")
    spark.createDataFrame(corpora, "corpus string, form string, record_element string, target_record_bytes bigint, overlap_bytes bigint").write.parquet(f"{base}/stream_configs.parquet")
    spark.createDataFrame([(1, 0, "<b>x</b>"), (1, 0, "<b>x</b>"), (2, 0, None)], "fragment_id bigint, index bigint, record string").write.parquet(f"{base}/fragments.parquet")
    documents = [(k, "one two three, " * (k % 9 + 1), "small" if k % 10 == 0 else "big") for k in range(200)]
    spark.createDataFrame(documents, "doc_id bigint, text string, source string").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([("small", 40, 3), ("big", 60, 2)], "source string, target_pct bigint, max_repeats bigint").write.parquet(f"{base}/mix_targets.parquet")
    return base


def plan_of(spark, sf, name):
    return __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def rows_of(spark, sf, name):
    return sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, sf).collect())


def test_p1_looks_up_the_template(spark, sf):
    plan = plan_of(spark, sf, "p1_found")
    assert "LeftOuter" in plan and "_template" in plan and "array_intersect" in plan and "nodes" in plan
    found = rows_of(spark, sf, "p1_found")
    assert ("fragments", 1, "html") in found and sum(r[2] == "wiki" for r in found) == 40
    kinds = residue.markup(spark.createDataFrame([("s", k, "h", f"== Menu ==\n\n'''Page''' {k}") for k in range(40)], "src string, item_id bigint, host string, text string")).collect()
    assert all(r["kept"] == r["template"] == ["wiki"] for r in kinds)  # the heading is template, the rest is kept


def test_p2_reads_the_cuts(spark, sf, monkeypatch):
    assert "max(needed" in plan_of(spark, sf, "p2_found")
    before = rows_of(spark, sf, "p2_found")
    assert before and {b for _, b in before} <= set(pieces.LEVELS)


def test_p3_reads_the_pivoted_tables(spark, sf):
    plan = plan_of(spark, sf, "p3_found")
    assert "Generate explode" in plan and "collect_list" in plan and "row_path" in plan
    assert len(rows_of(spark, sf, "p3_found")) == 40 * 4


def test_p4_needs_a_failed_rule(spark, sf):
    plan = plan_of(spark, sf, "p4_found")
    assert all(name in plan for name in quality.RULES)
    assert rows_of(spark, sf, "p4_found") and all(r[1] != "prose" for r in rows_of(spark, sf, "p4_found"))


def test_p6_compares_scores(spark, sf):
    plan = plan_of(spark, sf, "p6_found")
    assert "residual" in plan and "EXPM1" in plan.upper()
    assert {t for _, t in rows_of(spark, sf, "p6_found")} == {"gizofo"} or rows_of(spark, sf, "p6_found") == []


def test_p8_draws_from_the_tree(spark, sf, monkeypatch):
    assert "FlatMapGroupsInPandas" in plan_of(spark, sf, "p8_found")
    assert rows_of(spark, sf, "p8_found") == [("small", 3, "capped")]
    monkeypatch.setattr(mixing, "draws", lambda planned, config=None: spark.createDataFrame([], mixing._DRAWN))
    assert rows_of(spark, sf, "p8_found") == []
