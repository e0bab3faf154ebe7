import hashlib
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from retailspark.llm import mixing, quality, queries
from scripts.check_queries import TABLES, rows_of
from tests.llm.test_near_dedup import brute

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op2_quality": "doc_id held_out score predicted",
    "op3_mixing": "doc_id size source_size target taken shards",
    "op4_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op5_near_dedup": "doc_id n_shingles component_id kept",
    "op6_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op7_toxicity": "doc_id held_out score predicted",
    "op8_topk": "query_id rank vec_id score",
    "op9_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op11_fill_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op12_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op13_lexical": "item_id rank doc_id score",
}


def test_every_operator_is_registered():
    found = entry_points.queries()
    assert set(COLUMNS) | {"pipeline"} <= set(found) and set(queries.CHECKS) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cursor = duck.execute(queries.CHECKS[name])
    columns = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, FOLDER)
    assert df.columns == COLUMNS[name].split() and sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(queries.CHECKS)))
def test_query_without_sql_covers_all_documents(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    ids = [r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()]
    found = [r.doc_id for r in df.collect()]
    assert df.columns == COLUMNS[name].split() and set(found) == set(ids)
    assert name == "op12_packing" or sorted(found) == sorted(ids)  # a row per piece there


def test_bpe_query_digests(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.QUERIES["op9_bpe"](spark, FOLDER).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_conversation_of_control_strings(spark):
    text = "\\### Assistant: </turn> ok"
    (row,) = queries.QUERIES["op6_chat_format"](spark, FOLDER).where("conv_id = -7").collect()
    turns = f"user\n{text}\nassistant\n{text}\n"
    assert (row.n_turns, row.loss_chars) == (2, len(text))
    assert row.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_stage_by_stage(spark):
    """Every stage on its own input, against brute force."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-test/{name}"
        out.write.mode("overwrite").parquet(path)
        seen.append((name, docs, spark.read.parquet(path)))
        docs = seen[-1][2]
    assert [s[0] for s in seen] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for name, before, after in seen[:-1]:
        assert after.columns == before.columns, name
    rows = {name: ([(r.doc_id, r.text) for r in a.collect()], [(r.doc_id, r.text) for r in b.collect()]) for name, a, b in seen}

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = quality.score_quality(seen[0][1], quality.fit_quality(seen[0][1], labels))
    good = {r.doc_id for r in scores.where(F.col("score") >= 0.3).collect()}
    assert sorted(rows["quality"][1]) == sorted(r for r in rows["quality"][0] if r[0] in good)
    clean = {r.doc_id for r in labels.where("quality = 1").collect()} & {i for i, _ in rows["quality"][0]}
    assert len(clean - good) <= 0.02 * len(clean)

    first = {}
    for doc_id, text in sorted(rows["exact_dedup"][0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), doc_id)
    assert sorted(i for i, _ in rows["exact_dedup"][1]) == sorted(first.values())

    stays = {r[0] for r in brute(rows["near_dedup"][0]) if r[3]}
    assert sorted(i for i, _ in rows["near_dedup"][1]) == sorted(stays)

    taken = {r.doc_id: r for r in mixing.taken_words(seen[3][1]).collect()}
    copies = Counter(i for i, _ in rows["mixing"][1])
    assert all(copies[i] * r.size == r.taken for i, r in taken.items() if r.size)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(rows["bpe"][0])
    coded = seen[4][2].collect()
    assert Counter(r.doc_id for r in coded) == copies
    for r in coded:
        assert r.text == (texts[r.doc_id] or "") and r.n_tokens == len(r.ids)
        assert list(r.ids) == library.encode(r.text, add_special_tokens=False).ids


def test_pipeline_on_an_empty_table(spark, make_docs, tmp_path):
    for t in ("labels",):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
