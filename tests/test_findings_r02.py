"""Findings of round 2: registered queries over small tables made for them, against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sedimark.operators import graph
from sedimark.plans import extraction, registry
from sedimark.plans.base import Tables

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def same_as_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), folder / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    wanted = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLES[name]}) q").fetchall()
    found = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr) and found


#: The two words have one slot and opposite signs, so the second text's vector is zero.
DOCUMENTS = [{"doc_id": 1, "text": "void the lock"}, {"doc_id": 2, "text": "w10 w39"}, {"doc_id": 3, "text": "the w10 W39"}, {"doc_id": 4, "text": None}]


@pytest.mark.parametrize("name", ["o82_embed", "o83_backfill", "o85_knn_by_name"])
def test_words_that_take_each_other_away(spark, tmp_path, name):
    same_as_sql(spark, tmp_path, name, documents=DOCUMENTS, labels=[{"doc_id": 3}])


def part(key, name="red ring", size=3):
    return {"p_partkey": key, "p_name": name, "p_brand": "Brand#11", "p_type": "SMALL", "p_size": size, "p_retailprice": 1.0}


def test_definitions_that_differ_in_extent_alone(spark, tmp_path):
    """All rank alike up to the id; the ids fall, so that the first to come isn't the least."""
    rows = [part(k, f"ring {n}") for n in range(40) for k in range(1202 + 60000 * n, 2 + 60000 * n, -12)]
    same_as_sql(spark, tmp_path, "o46_best_definition", part=rows)


@pytest.mark.parametrize("name", ["u11_diffinfo", "u07_parameter_types", "u10_hunks", "o10_json_rows", "u06_parameters", "u05_macros"])
def test_python_hands_on_few_rows(spark, tmp_path, monkeypatch, name):
    """3,000 files in four tasks: no function over sources or diffs may gather a batch's results before it hands them on."""
    frame = type(spark.range(1))

    def watched(kind):
        whole = getattr(frame, kind)

        def with_check(df, f, schema, *more, **options):
            def run(batches):
                for out in f(batches):
                    if len(out) > 512:
                        raise ValueError(f"{len(out)} rows at once")
                    yield out

            return whole(df, run, schema, *more, **options)

        return with_check

    for kind in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(frame, kind, watched(kind))
    pq.write_table(pa.Table.from_pylist([part(k) for k in range(60_000)]), tmp_path / "part.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    assert df.collect()


@pytest.mark.parametrize("name", ["o70d_paths_to_target", "o70c_level_sets"])
def test_walks_send_nothing_large_to_all_tasks(spark, tmp_path, monkeypatch, name):
    """With nothing counted as few, no round of a walk may broadcast a side, however small Spark guesses it."""
    cut = graph.cut

    def checked(df):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        return cut(df)

    monkeypatch.setattr(graph, "cut", checked)
    monkeypatch.setattr(graph, "FEW", -1, raising=False)
    same_as_sql(spark, tmp_path, name, part=[part(k, size=k % 7) for k in range(400)])


def test_sources_send_no_call_lists_to_all_tasks(spark, tmp_path):
    """However small Spark guesses the edges, the files are made without them passing through the driver."""
    pq.write_table(pa.Table.from_pylist([part(k, size=k % 7) for k in range(400)]), tmp_path / "part.parquet")
    df = extraction._sources(Tables(spark, str(tmp_path)))
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["o82_embed", "o83_backfill", "o85_knn_by_name"])
def test_embedding_shuffles_texts_once_and_no_words(spark, tmp_path, name):
    """Words stay where their text is until they are codes; rows of a key are put together by one shuffle.  A key may have several rows."""
    again = [{"doc_id": 1, "text": "lock w10"}, {"doc_id": 2, "text": "W39 w10"}, {"doc_id": 5, "text": ""}, {"doc_id": 6, "text": "w39 " * 3 + "w10 " * 2}]
    same_as_sql(spark, tmp_path, name, documents=DOCUMENTS + again, labels=[{"doc_id": 3}])
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Exchange ") == 1 + (name == "o83_backfill"), plan  # the labels' keys have their own


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_backfill_shuffles_alike_whatever_the_size_of_labels(spark, tmp_path, threshold):
    """The texts go to their key's task once, for the join and the embedding together, and labels don't go through the driver."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        same_as_sql(spark, tmp_path, "o83_backfill", documents=DOCUMENTS, labels=[{"doc_id": 3}])
        plan = QUERIES["o83_backfill"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    shuffles = [i for i, x in enumerate(lines) if " Exchange " in x]
    assert len(shuffles) == 2 and "BroadcastHashJoin" not in plan, plan
    assert "FileScan" in lines[shuffles[0] + 1] and "text#" in lines[shuffles[0] + 1], plan
