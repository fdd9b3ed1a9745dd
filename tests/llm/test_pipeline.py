from collections import defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from test_neardup import brute_classes
from test_packing import PATH, plain_ids
from test_quality import brute
from tidemark.llm import langid, neardup, packing
from tidemark.llm.common import forget


def documents(n):
    rng = np.random.default_rng(8)
    words = "the of and to in is that for it with river stone cloud grass light under winter summer carry follow".split()
    rows = []
    for i in range(n):
        body = rng.choice(words, int(rng.integers(60, 200))).tolist()
        body = [w if j % 3 else f"{w}{chr(97 + int(rng.integers(26)))}{chr(97 + int(rng.integers(26)))}" for j, w in enumerate(body)]
        rows.append((i, " ".join(body), "en", "s", 1))
    rows += [(1000 + i, rows[3][1], "en", "s", 1) for i in range(5)]
    letters = np.array(list("qxzjkvwy"))
    strange = [" ".join(["the of and to", *("".join(rng.choice(letters, 9)) for _ in range(70))]) for _ in range(3)]
    rows += [(3000 + i, f"{t} the of and to", None, "s", 1) for i, t in enumerate(strange)]  # in no language of the labels
    rows += [(2000, None, "en", "s", 1), (2001, "", None, "s", 1), (2002, "# " * 90, "en", None, 1), (2003, rows[4][1] + " end", "en", "s", None)]
    return rows


def test_stages_equal_brute_force(spark, tmp_path):
    rows = documents(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, text = {}, {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        models = langid.fit(docs) if name == "language ID" else None
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        before = sorted(r.doc_id for r in docs.collect())
        docs = spark.read.parquet(path)
        kept[name] = sorted(r.doc_id for r in docs.collect())
        if name == "quality rules":
            assert not {i for i in kept[name] if brute(text[i])[-1]} and {2000, 2001, 2002}.isdisjoint(kept[name])
            assert set(range(60)) <= set(kept[name])
        elif name == "language ID":
            assert kept[name] == [i for i in before if not langid.judge(models, text[i])[3]]
            assert set(before) - set(kept[name]) == {3000, 3001, 3002}
        else:
            assert kept[name] == sorted(set(brute_classes([(i, text[i]) for i in before])))
            assert 2003 not in kept[name] and 1000 not in kept[name]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths = defaultdict(int)
    for p in pieces:
        lengths[p.doc_id] += p.length
    assert lengths == {i: len(plain_ids(text[i])) for i in kept["near duplicates"]}


def test_stages_carry_clashing_columns(spark, tmp_path):
    names = ["__key", "__id", "key", "kept", "n_words", "rejected", "score", "hub", "__row", "__text", "t", "id", "words", "start"]
    rows = [(*r, *range(len(names))) for r in documents(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {tuple(r[n] for n in names) for r in docs.collect()} == {tuple(range(len(names)))}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


@pytest.mark.parametrize("k", range(4))
def test_each_stage_takes_an_empty_table(spark, k):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.STAGES[k][1](spark, docs, "unused").count() == 0


def test_workers_keep_no_memo_of_an_earlier_stage(spark):
    docs = spark.createDataFrame(documents(60), "doc_id long, text string, lang string, source string, n_chars long")

    def kept(batches):
        for batch in batches:
            words = [own.words for own in packing._TOKENIZERS.values()]
            n = [len(neardup._WORDS), sum(len(w) + len(w.old) for w in words)]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in n], ["hashes", "packed"])

    def most():
        r = spark.range(0, 64, 1, 16).mapInArrow(kept, "hashes long, packed long").agg({"hashes": "max", "packed": "max"})
        return tuple(r.select("max(hashes)", "max(packed)").first())

    packing._cut_documents(docs, PATH, "doc_id", "text").count()
    assert most()[1] > 0  # the next task of the stage looks words up here
    corpus_pipeline.near_duplicate_stage(spark, docs, "").count()
    assert most()[0] == 0
    own = packing.word_tokenizer(PATH)
    own.encode_batch(["some words"]), neardup.word_hashes("some words")
    forget(but="packed words")
    assert own.words and not neardup._WORDS
    forget()
    assert not own.words and not own.words.old
