import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import langid

TEXTS = {
    "aa": ["the cat and the dog on the mat", "then that hat and these other things", "a thin moth"],
    "bb": ["der hund und die katze im haus", "und dann noch einmal über die straße", "ein süßer apfel"],
}


def counts_of(texts):
    seen = Counter()
    for t in texts:
        c = langid.characters(t).tolist()
        seen.update(tuple(c[i : i + langid.ORDER]) for i in range(len(c) - langid.ORDER + 1))
    return dict(seen)


def arrays_of(texts):
    counts = counts_of(texts)
    return np.array(list(counts), np.uint32).reshape(-1, langid.ORDER), np.array(list(counts.values()))


def plain_bits(texts, text):
    """Kneser-Ney by its formula, over dictionaries; sum of log2 after the first character."""
    levels = {langid.ORDER: counts_of(texts)}
    for n in range(langid.ORDER - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    total = sum(levels[1].values()) + 1

    def p(gram):
        if len(gram) == 1:
            return levels[1].get(gram, 1) / total if gram in levels[1] else 1 / total
        history = [c for g, c in levels[len(gram)].items() if g[:-1] == gram[:-1]]
        if not history:
            return p(gram[1:])
        found = levels[len(gram)].get(gram, 0)
        return (max(found - langid.DISCOUNT, 0) + langid.DISCOUNT * len(history) * p(gram[1:])) / sum(history)

    c = tuple(langid.characters(text).tolist())
    return sum(math.log2(p(c[max(0, i - langid.ORDER + 1) : i + 1])) for i in range(1, len(c)))


@pytest.mark.parametrize("text", ["the hund", "zzz qqq", "a", "und the über ωmega", "that thing then", "x" * 50])
@pytest.mark.parametrize("stretch", [1 << 20, 3])
def test_sorted_arrays_equal_the_formula(monkeypatch, text, stretch):
    monkeypatch.setattr(langid, "STRETCH", stretch)
    models = langid.build_models({k: arrays_of(v) for k, v in TEXTS.items()})
    got = langid.log_probabilities(models, langid.characters(text))
    want = [plain_bits(TEXTS[k], text) for k in models.languages]
    assert np.allclose(got, want, atol=1e-6)


def test_characters():
    show = lambda t: "".join(map(chr, langid.characters(t)))
    assert show("Ab1-2c  É\n") == " ab c é "
    assert show("") == " " and show("123 !?") == " "
    assert show("漢𝒜x😀y") == " 漢𝒜x y "


def test_verdicts_equal_the_formula():
    """Language, score, entropy and rejection recomputed from `plain_bits`; equal languages go by name."""
    models = langid.build_models({k: arrays_of(v) for k, v in {**TEXTS, "ab": TEXTS["aa"]}.items()})
    models.limits = np.array([(2.0, 1.5), (2.0, 1.5), (1.5, 1.0)])
    for text in ("the other cat", "der hund und das haus", "zzz qqq xxx", "ein", "that THAT, that! 12"):
        n = len(langid.characters(text)) - 1
        bits = [-plain_bits(TEXTS[k], text) / n for k in ("aa", "aa", "bb")]
        best = bits.index(min(bits))
        share = 1 / sum(2 ** ((bits[best] - b) * langid.SHARPNESS) for b in bits)
        mean, room = models.limits[best]
        excess = (bits[best] - mean) / (room + langid.REJECT_SHORT_BITS / math.sqrt(n))
        want = (("aa", "ab", "bb")[best], share * min(1.0, max(0.0, 1.0 - max(0.0, excess) ** 4)), bits[best], excess > 1)
        got = langid.judge(models, text)
        assert got[0] == want[0] and np.allclose(got[1:3], want[1:3], atol=1e-6) and got[3] == want[3]


def test_unclear_texts_are_und():
    models = langid.build_models({k: arrays_of(v) for k, v in TEXTS.items()})
    for text in (None, "", "12 34 !?"):
        assert langid.judge(models, text) == ("und", 0.0, 0.0, True)
    assert langid.judge(langid.build_models({}), "hello")[0] == "und"


def test_held_out_accuracy_rejection_and_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = langid.fit(docs)
    rows = {r.doc_id: r for r in langid.identify(docs, models).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held)
    assert all(0.0 <= r.score <= 1.0 for r in rows.values())
    rng = np.random.default_rng(1)
    noise = "".join(rng.choice(list("qxzjkvwypf"), 400))
    odd = [(1, noise, "x", 1), (2, None, "y", 2), (3, "...", None, 3), (4, "The thing of the and was there", "z", 4), (None, "the other and", "", 5)]
    frame = spark.createDataFrame(odd, "doc_id long, text string, lang_pred string, score int")
    judged = {r.doc_id: r for r in langid.identify(frame, models).collect()}
    assert judged[1].rejected and judged[2].lang_pred == judged[3].lang_pred == "und" and not judged[4].rejected
    assert not judged[None].held_out
    kept = langid.keep_identified(frame, models)
    assert kept.columns == frame.columns
    assert sorted(r.score for r in kept.collect()) == [4, 5]
    share = langid.keep_identified(docs, models).count() / docs.count()
    assert share > 0.99


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify_languages(docs).count() == 0
