import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import licenses

INDEX = licenses.build_index(1000, {b"the": 900, b"of": 800, b"license": 20, b"by": 700, b"and": 850})


def brute_base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [
        (i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["gnu", "GNU", "general", "public", "License", "license-", "mit", "MIT", "cc", "by", "CC-BY", "apache", "é", "x,y", "\n", "\x7f", "Ａ"]), max_size=30))
def test_base_equals_brute_force(parts):
    text = " ".join(parts)
    assert licenses.scan_text(INDEX, text)[:5] == brute_base(text)


def test_each_template_gives_its_label():
    for template in licenses.TEMPLATES:
        for text in (template.text, f"Some words before.\n{template.text.upper()}, and after"):
            row = licenses.scan_text(INDEX, text)
            assert template.label in row[5].split(",") and row[6] == 1.0


def test_key_phrases_are_mandatory_and_small_changes_are_not():
    body = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    assert licenses.scan_text(INDEX, body.replace("hereby", "now"))[5] == ""
    row = licenses.scan_text(INDEX, body.replace("associated", "other"))
    assert row[5] == "mit-text" and 0.9 < row[6] < 1.0
    assert licenses.scan_text(INDEX, "the license of the software is without a name")[5:] == ("", 0.0)


def brute_templates(words):
    """Each template at each offset, word by word."""
    want = {}
    for t in licenses.TEMPLATES:
        body = t.text.encode().split()
        keys = [k.encode().split() for k in t.key_phrases]
        at = lambda i: words[i] if 0 <= i < len(words) else None  # noqa: E731, B023
        for o in range(-len(body), len(words)):
            share = sum(at(o + i) == w for i, w in enumerate(body)) / len(body)
            ok = all(
                any(body[i : i + len(k)] == k and all(at(o + i + j) == w for j, w in enumerate(k)) for i in range(len(body))) for k in keys
            )
            if ok and share >= licenses.LEAST_SHARE:
                want[t.label] = max(share, want.get(t.label, 0))
    return want


def test_an_index_that_looks_at_every_place_agrees():
    """No template that stands in the text is lost, however damaged, cut off or surrounded by its own words."""
    rng = random.Random(2)
    pool = " ".join(t.text for t in licenses.TEMPLATES).encode().split()
    found = 0
    for template in licenses.TEMPLATES * 2:
        body = template.text.encode().split()
        phrases = [p.encode().split() for p in template.key_phrases]
        fixed = {i + j for p in phrases for i in range(len(body)) if body[i : i + len(p)] == p for j in range(len(p))}
        damaged = [w if i in fixed or rng.random() > 0.37 else rng.choice(pool) for i, w in enumerate(body)]
        words = rng.choices(pool, k=rng.randint(0, 12)) + damaged[: rng.randint(len(damaged) // 2, len(damaged))] + rng.choices(body, k=20)
        want = brute_templates(words)
        assert licenses.match_templates(licenses.Places(INDEX, words)) == want
        found += template.label in want
    assert found > 30


def test_long_texts_take_time_in_proportion():
    many = "the " * 200_000 + "apache license " * 20_000 + " ".join(licenses.TEMPLATES[7].text.split() * 3000)
    began = time.process_time()
    row = licenses.scan_text(INDEX, many)
    assert row[1] == 20_000 and "mit-text" in row[5] and time.process_time() - began < 5


def test_rows(spark):
    rows = [(1, "Released under the MIT License.", "x", 1), (2, None, "y", 2), (3, "", None, 3), (1, "Released under the MIT License.", "x", 1)]
    rows += [(None, "word " * 50000 + "gnu general public license", "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(got) == 4 and licenses.scan(docs).count() == 5
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].base_labels, got[1].labels) == (5, 1, 3, "mit", "mit")
    assert got[2].n_words == 0 and got[2].first_word is None and got[2].labels == "" and got[2].score == 0.0
    assert got[None].first_word == 50000
    n, frequency = licenses.document_frequency(docs)
    assert n == 5 and frequency[b"license"] == 3 and frequency[b"gnu"] == 1
    assert licenses.scan(docs.limit(0)).count() == 0
