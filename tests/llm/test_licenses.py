"""License scans against a brute-force version: every block with every template."""

import random
import re

import pytest

from dosewise.llm import license_scan
from dosewise.llm.common import term_lists
from dosewise.llm.license_scan import BLOCK, STEP, TEMPLATES, Template, digest, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(doc_id, text, templates):
    ws = words(text)
    places, labels, best = [], set(), 0.0
    for t in templates:
        seq = words(t.text)
        if t.phrase:
            at = [i for i in range(len(ws)) if ws[i : i + len(seq)] == seq]
            places += at
            if at:
                labels.add((t.label, True))
                best = 1.0
            continue
        for k in range(0, len(ws), STEP):
            share = len(set(ws[k : k + BLOCK]) & set(seq)) / len(set(seq))
            if share >= t.least - 1e-12:
                labels.add((t.label, False))
                best = max(best, share)
    return (doc_id, len(ws), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted({x for x, p in labels if p})), ",".join(sorted({x for x, _ in labels})), best)


def check(docs, templates=TEMPLATES):
    got = sorted((tuple(r) for r in digest(scan(docs, templates)).collect()), key=repr)
    want = sorted((brute(r.doc_id, r.text, templates) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert got == want
    return got


def test_changed_notices_across_blocks(spark):
    rnd = random.Random(5)
    filler = [f"w{i}" for i in range(40)] + ["the", "license", "of", "to", "software", "cc", "mit"]
    rows = []
    for i in range(150):
        ws = rnd.choices(filler, k=rnd.randrange(0, 400))
        for _ in range(rnd.randrange(3)):
            notice = words(rnd.choice(TEMPLATES).text)
            for _ in range(rnd.randrange(len(notice) // 3 + 1)):  # some pass the share, some fall short
                notice[rnd.randrange(len(notice))] = rnd.choice(filler)
            at = rnd.randrange(len(ws) + 1)
            ws[at:at] = notice
        rows.append((i, rnd.choice([" ", "\n", " - ", "\x00"]).join(w.upper() if rnd.random() < 0.2 else w for w in ws)))
    got = check(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sum(1 for r in got if "notice" in r[6]) > 15


def test_odd_and_no_documents(spark, odd_docs, no_docs):
    check(odd_docs)
    assert scan(no_docs).collect() == []


def test_borders_ties_and_overlapping_phrases(spark):
    rows = [(1, "x " * 62 + "gnu general public license " + "y " * 100), (2, "MIT LICENSE"), (3, "cc by cc by cc-by"), (4, "mit; license"),
            (5, "apache apache license license"), (5, "apache apache license license"), (6, "É" * 3 + "mit license"), (7, "a " * 63 + "mit license"),
            (8, "a " * 127 + "mit license"), (None, "Apache\tLicense")]
    got = check(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert [r[2] for r in got if r[0] in (1, 7, 8)] == [1, 1, 1]


def test_long_text_in_pieces():
    text = (" ".join(f"Ab{i}é" for i in range(50_000))).encode()
    assert [w for ws in term_lists(text, 1000) for w in ws] == [f"ab{i}é".encode() for i in range(50_000)]
    assert [w for ws in term_lists(b"a" * 5000 + b" b", 1000) for w in ws] == [b"a" * 5000, b"b"]
    assert list(term_lists(b"")) == list(term_lists(b" .\x00")) == []


def test_unusable_templates(spark, odd_docs):
    for t in (Template("long", " ".join(f"x{i}" for i in range(BLOCK)), 0.8), Template("none", "...", 0.8), Template("share", "a b", 0.0)):
        with pytest.raises(ValueError):
            scan(odd_docs, [t])


def test_join_filters_before_it_verifies(spark):
    """A block with enough words of a template but none in its prefix cannot exist; one with too few never meets it."""
    rows = license_scan._template_rows([Template("t", "a b c d e", 0.6)], {w.encode(): k + 1 for k, w in enumerate("abcde")})
    assert [r[0] for r in rows] == [1, 2, 3] and rows[0][8] == 3
