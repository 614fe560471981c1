"""Every stage of the corpus pipeline, on what the one before it kept, against a plain version."""

from collections import defaultdict

import sentencepiece
from test_documents import brute_components, brute_fingerprint, brute_mix, brute_repeats, measures, words

import __spark_entry__
import corpus_pipeline
from dosewise.llm.common import read, stored
from dosewise.llm.queries import piece_model


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, sf):
    docs = read(spark, sf, "documents")
    kept = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5

    ruled = stored(kept["quality rules"](spark, docs, sf), "t")
    passes = lambda t: (m := measures(t))[0] >= 10 and 100 * m[4] <= 20 * m[0]
    assert rows(ruled) == [r for r in rows(docs) if passes(r[1])]  # too few labels here for any cutoff

    single = stored(kept["simhash"](spark, ruled, sf), "t")
    base = rows(ruled)
    comps = brute_components([r[0] for r in base], [brute_fingerprint(r[1]) for r in base])
    assert rows(single) == [r for r, c in zip(base, comps) if r[0] == c]

    cut = stored(kept["substring dedup"](spark, single, sf), "t")
    plain = {d: (n, kept_words) for d, _, n, kept_words in brute_repeats([(r[0], r[1]) for r in rows(single)])}
    before = {r[0]: r for r in rows(single)}
    for r in rows(cut):
        n, text = plain[r[0]]
        assert words(r[1]) == text.split(" ") if text else r[1].strip() == ""
        assert (r[1], r[4]) == (before[r[0]][1], before[r[0]][4]) if not n else r[4] == len(r[1])
        assert r[2:4] == before[r[0]][2:4]
    assert len(plain) == cut.count()

    mixed = stored(kept["mixing"](spark, cut, sf), "t")
    sizes, target = brute_mix([(r[0], r[3], r[1]) for r in rows(cut)])
    got, source = defaultdict(int), {r[0]: r[3] for r in rows(cut)}
    for r in rows(mixed):
        got[source[r[0]]] += len(words(r[1]))
    for s in sizes:
        assert abs(got[s] - target[s]) <= 1

    out = kept["sentencepiece"](spark, mixed, sf)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    assert sorted(r["n_tokens"] for r in out.collect()) == sorted(len(library.encode(r["text"])) for r in mixed.collect())
    for stage in (ruled, single, cut, mixed):
        assert stage.columns == docs.columns
    assert rows(corpus_pipeline.run(spark, sf)) == rows(out)


def test_stages_take_odd_and_no_documents(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, sf), "t")
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_all_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names
