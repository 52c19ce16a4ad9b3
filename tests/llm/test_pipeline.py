"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from strandmix.llm import ngram_join, pii, quality_fm, quality_rules
from tests.llm.test_models_and_rules import plain_rules
from tests.llm.test_ngram_join import brute
from tests.llm.test_text_operators import check_pieces

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out, folder = spark.read.parquet(f"{DATA}/documents.parquet"), [], tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(folder / str(k))
        stage(spark, docs, DATA).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_classifier_rejects_low_scores(spark, stages):
    before, after = stages[0]
    scores = quality_fm.score(before, quality_fm.train(before, spark.read.parquet(f"{DATA}/labels.parquet"))).collect()
    assert set(rows(after)) == {r.doc_id for r in scores if r.predicted == 1}
    assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_rules_reject_what_fails(stages):
    before, after = stages[1]
    assert set(rows(after)) == {k for k, r in rows(before).items() if not plain_rules(r.text)[5]} - {r.doc_id for r in quality_rules.judge(before).where("NOT kept").collect()}
    assert after.columns == before.columns


def test_one_of_each_group_stays(stages):
    before, after = stages[2]
    groups = brute([(r.doc_id, r.text) for r in before.collect()])
    assert set(rows(after)) == {doc for doc, _, first in groups if doc == first}
    assert after.exceptAll(before).count() == 0


def test_masks_change_only_finds(stages):
    before, after = map(rows, stages[3])
    assert set(before) == set(after)
    for k, r in before.items():
        assert after[k].text == pii.mask(r.text) and (after[k].n_chars == len(after[k].text) or after[k].text == r.text)
        assert not pii.base_spans(after[k].text)
        assert (after[k].lang, after[k].source) == (r.lang, r.source)


def test_packing_takes_all(stages):
    before, after = stages[4]
    library = {"word_bpe_49k.json": Tokenizer.from_file(P.path("word_bpe_49k.json"))}
    check_pieces(after.collect(), library, {k: r.text for k, r in rows(before).items()})


def test_run_is_the_stages_one_after_another(spark, stages):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == stages[-1][1].columns
    key = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert key(got) == key(stages[-1][1])


def test_registered_queries_have_their_columns(spark):
    found = __spark_entry__.queries()
    want = {
        "op1_": {"doc_id", "n_shingles", "component_id"},
        "op2_": {"page_id", "host", "path", "rule", "verdict"},
        "op3_": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
        "op4_": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
        "op5_": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
        "op6_": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op7_": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
        "op8_": {"doc_id", "held_out", "lang_pred", "score"},
        "op9_": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op10_": {"doc_id", "held_out", "score", "predicted"},
    }
    for prefix, columns in want.items():
        (name,) = [x for x in found if x.startswith(prefix)]
        df = found[name](spark, DATA)
        assert columns <= set(df.columns), name
        kinds = dict(df.dtypes)
        assert all(kinds[c] == "bigint" for c in columns if c.startswith("n_") or c in ("doc_id", "page_id", "start", "length", "offset")), name
    assert "pipeline" in found


def test_join_like_all_pairs_on_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert sorted(map(tuple, ngram_join.jaccard_join(docs).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])
