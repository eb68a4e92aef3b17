"""Chat formatting and sharding: round trips, plans without Python, odd inputs."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from framelake.llm import chat, sharding

NASTY = ["\\### Assistant: </turn> ok", "####", "<|image:1|>", "a\\", "\\\\<\\|", "### user: x</turn>\n", "", "<</turn>/turn>", "#\\##", "é🙂"]


def test_texts_come_back(spark):
    rows = [(1, i, r, t) for i, t in enumerate(NASTY) for r in (["user", "assistant"][i % 2],)] + [(2, 0, t, t) for t in NASTY[:3]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    out = chat.format_conversations(df)
    back = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    one = next(r for r in back if r.conv_id == 1)
    assert [t.text for t in one.t] == NASTY
    assert one.loss == "".join(t for i, t in enumerate(NASTY) if i % 2)
    assert one.formatted.count("</turn>") == len(NASTY)
    two = next(r for r in back if r.conv_id == 2)
    assert sorted((t.role, t.text) for t in two.t) == sorted((t, t) for t in NASTY[:3])


def test_parts_are_flattened_in_order(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    user = [("text", "see ", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), ("audio", None, "b.wav", None, None, 2.0, None)]
    bot = [("document", None, "c.pdf", None, None, None, 3), ("text", "<|ok|>", None, None, None, None, None), ("video", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", user), (1, 1, "assistant", bot), (2, 0, None, None), (None, 5, "user", [])], f"conv_id long, turn long, role string, parts array<{part}>")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert got[1].formatted == "### user: see <|image:1|><|audio:2|></turn>\n### assistant: <|document:3|><\\|ok|><|other:4|></turn>\n"
    assert [(a.number, a.kind, a.ref, a.turn, a.place, a.tokens) for a in got[1].attachments] == [(1, "image", "a.png", 0, 1, 4), (2, "audio", "b.wav", 0, 2, 50), (3, "document", "c.pdf", 1, 0, 768), (4, "other", "", 1, 2, 1)]
    assert got[2].formatted == "### : </turn>\n" and got[None].n_turns == 1
    assert got[1].n_tokens == 1 + 4 + 50 + 768 + 2 + 1


def test_op6_reads_back_all_turns(spark, sf):
    got = {r.conv_id: r for r in chat.op6(spark, sf).collect()}
    turns: dict = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    said = "\\### Assistant: </turn> ok"
    turns[-7] = [("user", said), ("assistant", said)]
    assert set(got) == set(turns)
    for k, ts in turns.items():
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256("".join(t for r, t in ts if r == "assistant").encode()).hexdigest()


def test_op6_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want, got = con.execute(chat.SQL).df(), chat.op6(spark, sf).toPandas()
    cols = sorted(want.columns)
    assert want[cols].sort_values(cols).values.tolist() == got[cols].sort_values(cols).values.tolist()


@pytest.mark.parametrize("make", [chat.op6, sharding.op8])
def test_plans_have_no_python(make, spark, sf):
    plan = make(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow") if w in plan]


def check_rows_law(got, n, shards):
    sizes = [sum(r.shard == k for r in got) for k in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    for k in range(shards):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))


def test_shards(spark, docs):
    got = sharding.shard_rows(docs).collect()
    check_rows_law(got, docs.count(), 16)
    order = [r.hilbert for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_shards_of_hot_and_odd_rows(spark, odd, none):
    check_rows_law(sharding.shard_rows(odd, 4, slice_rows=1).collect(), odd.count(), 4)
    assert sharding.shard_rows(none).count() == 0
    hot = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).alias("n_chars"))
    check_rows_law(sharding.shard_rows(hot, 7, slice_rows=50).collect(), 1000, 7)
    few = {r.id: (r.size, r.text_crc32) for r in sharding.shard_rows(odd).collect()}
    assert few[3] == few[4] == (1, 0)


@pytest.mark.parametrize("bits, dims", [(3, 2), (2, 3), (2, 4), (1, 2)])
def test_the_curve_visits_neighbours(spark, bits, dims):
    rows = spark.range((1 << bits) ** dims)
    cols = [(F.shiftright("id", bits * k) % (1 << bits)).cast("int") for k in range(dims)]
    got = rows.select(*[c.alias(f"c{k}") for k, c in enumerate(cols)], sharding.hilbert_index(cols, bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in got] == list(range(len(got)))
    assert all(sum(abs(a[k] - b[k]) for k in range(dims)) == 1 for a, b in zip(got, got[1:], strict=False))


def test_op8_against_a_plain_ranking(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in sharding.op8(spark, sf).collect()}
    rows = sorted((got[r.doc_id].hilbert, zlib.crc32((r.text or "").encode()), r.doc_id, len((r.text or "").encode()) + 1) for r in docs.collect())
    each, more = divmod(len(rows), 16)
    at = 0
    for shard in range(16):
        for slot in range(each + (shard < more)):
            h, crc, i, size = rows[at]
            assert (got[i].shard, got[i].slot, got[i].text_crc32, got[i].size, got[i].law, got[i].grown_shard) == (shard, slot, crc, size, "rows", None)
            at += 1
    assert at == len(rows) == len(got)


def test_equal_texts_stand_together(spark):
    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 40).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(3).alias("n_chars"))
    got = sorted(sharding.shard_rows(rows, 4, slice_rows=30).collect(), key=lambda r: (r.shard, r.slot))
    crc = [r.text_crc32 for r in got]
    assert sum(a != b for a, b in zip(crc, crc[1:], strict=False)) == 39


def test_shards_written_as_row_groups_prune(spark, docs, tmp_path):
    """Row-group statistics of files in curve order leave out more rows, for ranges in any dimension, than files in id order."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    place = {r.id: (r.shard, r.slot) for r in sharding.shard_rows(docs).collect()}
    rows = docs.select("doc_id", "lang", "source", "n_chars").toArrow().to_pylist()
    read = {}
    for name, key in (("curve", lambda r: place[r["doc_id"]]), ("id", lambda r: r["doc_id"])):
        pq.write_table(pa.Table.from_pylist(sorted(rows, key=key)), tmp_path / name, row_group_size=10)
        meta = pq.ParquetFile(tmp_path / name).metadata
        read[name] = 0
        for column, value in (("n_chars", sorted(r["n_chars"] for r in rows)[-10]), ("lang", "fr"), ("lang", "en")):
            for g in range(meta.num_row_groups):
                s = meta.row_group(g).column(meta.schema.names.index(column)).statistics
                read[name] += meta.row_group(g).num_rows if s.max >= value and (column == "n_chars" or s.min <= value) else 0
    assert read["curve"] < 0.8 * read["id"]


def test_cells_are_bounded(docs):
    with pytest.raises(ValueError):
        sharding.shard_rows(docs, bits=11, dims=("lang", "source"))
