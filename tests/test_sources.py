"""Sources, sinks, streams and the catalogue."""

import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from termforest.operators import relational as R
from termforest.operators import vectors as V
from termforest.sources import readers, writers
from termforest.streaming import events as E


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return data.getvalue()


def test_files_become_texts_or_failures(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>One <b>two</b><script>x()</script><nav>menu</nav><p>three &amp; four")
    (tmp_path / "b.docx").write_bytes(docx("First", "", "Second"))
    (tmp_path / "c.txt").write_bytes(b"plain \xff text")
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    got = {r["path"][-6:]: r for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got["a.html"]["text"] == "One\n\ntwo\n\nthree & four" and got["b.docx"]["text"] == "First\n\nSecond" and got["/c.txt"]["text"] == "plain  text"
    assert got["d.docx"]["status"] == got["/e.pdf"]["status"] == "FAILED" and "no extractor" in got["/e.pdf"]["error"]


def test_chunks(spark):
    assert readers.pack("", 100) == [] and [c[0] for c in readers.pack("One.\n\nTwo.", 100)] == ["One.", "Two."]
    many = readers.pack(" ".join(["Word sentence."] * 80), 200)
    assert len(many) > 1 and all(len(t) <= 250 for t, _, _ in many)
    assert readers.merge_short([("short", 0, 5), ("tiny", 6, 10), ("a much longer chunk here!", 11, 36)], 40, 8)[0] == ("short tiny", 0, 10)
    df = spark.createDataFrame([(1, "A b.\n\nC d."), (2, None), (3, "")], "id int, text string")
    assert [r["chunk"] for r in readers.chunk_texts(df, "text").collect()] == ["A b. C d."]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    writers.replace_partitions(df, f"{tmp_path}/t", ["k"])
    writers.replace_partitions(spark.createDataFrame([("a", 9)], "k string, v int"), f"{tmp_path}/t", ["k"])
    assert {(r["k"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {("a", 9), ("b", 2)}
    rows = spark.createDataFrame([('say "hi", you', 0.5)], "label string, score double")
    writers.write_csv(rows, f"{tmp_path}/c")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/c").first()["label"] == 'say "hi", you'
    writers.write_tsv(rows, f"{tmp_path}/d")
    writers.write_json(rows, f"{tmp_path}/e")
    assert spark.read.json(f"{tmp_path}/e").count() == 1
    assert spark.range(1).select(readers.safe_name(F.lit("../x y/Отчёт №1.txt")).alias("n")).first()["n"] == "Отчёт__1.txt"


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    q = E.fold_state(E.read_stream(spark, f"{tmp_path}/in").dropna()).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["user_id"], r["last_type"], r["n"], r["top"]) for r in spark.table("folded").collect()}
    assert {tuple(r) for r in E.latest_state(events.dropna()).collect()} <= got


def test_read_operators(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 5, "w")], "k string, t int, id string")
    assert {r["id"] for r in R.latest_by(df, ["k"], "t", "id").collect()} == {"z", "w"}
    info = R.page_info(df, 1, 3).first()
    assert (info["total_elements"], info["total_pages"], info["first"], info["last"], info["empty"]) == (4, 2, False, True, False)
    rel = spark.createDataFrame([("r1", None), ("r2", "r1"), ("r3", "r2")], "id string, prev string")
    assert {(r["k"], r["origin"], r["steps"]) for r in R.lineage(rel, "id", "prev").collect()} == {("r1", "r1", 0), ("r2", "r1", 1), ("r3", "r1", 2)}
    settings = spark.createDataFrame([("a", 0.7), (None, 0.5)], "coll string, thr double")
    rows = spark.createDataFrame([("a",), ("b",)], "coll string")
    assert {(r["coll"], r["thr"]) for r in R.with_fallback(rows, settings, "coll", "thr").collect()} == {("a", 0.7), ("b", 0.5)}
    unit = spark.range(1).select(V.hashed_embedding(F.lit("battery storage"), 16).alias("v")).first()["v"]
    assert sum(x * x for x in unit) == pytest.approx(1.0)


@pytest.mark.parametrize("name", ["tfidf_top_terms", "p2_found", "term_frequencies", "connected_components", "graph_quality", "hearst_pairs", "pair_cooccurrence_support", "embedding_parents", "threshold_recompute", "user_sessions"])
def test_queries_match_sql(spark, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in ("collections", "concepts", "taxonomy_versions", "document_chunks", "taxonomy_edge_candidates", "taxonomy_edge_labels", "documents", "embeddings", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(df):
        return sorted((tuple(round(float(x), 6) if isinstance(x, float) else x for x in r) for r in df[columns].itertuples(index=False)), key=repr)

    assert rows(got) == rows(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
