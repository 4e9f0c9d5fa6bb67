"""the packed sequences of the pipeline follow the mix."""

from collections import Counter, defaultdict

import public_tokenizers

from triage.llm import mixing, packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_sequences_run_along_the_order(spark):
    docs = spark.createDataFrame([(k, f"word{k} " * (k * 37 % 90 + 1), (k * 7919) % 400) for k in range(400)] + [(900, "long " * 500, 399)], "doc_id long, text string, slot long")
    plain = packing.pack_documents(docs, WORDS, 128).collect()
    got = packing.pack_documents(docs, WORDS, 128, order="slot").collect()
    back = packing.pack_documents(docs.selectExpr("doc_id", "text", "399 - slot AS slot"), WORDS, 128, order="slot").collect()
    key = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(got) == key(plain) == key(back)
    assert len({r.sequence_id for r in got}) == len({r.sequence_id for r in plain})
    slot, by_length, by_sequence = {r.doc_id: r.slot for r in docs.collect()}, defaultdict(list), defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        by_length[r.length].append(slot[r.doc_id])
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert all(x == sorted(x) for x in by_length.values())
    for spots in by_sequence.values():
        assert [o for o, _ in spots] == [sum(n for _, n in spots[:k]) for k in range(len(spots))] and sum(n for _, n in spots) <= 128
    assert {r.doc_id: r.sequence_id for r in got} != {r.doc_id: r.sequence_id for r in back}


def test_mix_reaches_the_packing(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(k, f"text number {k} " * 40, f"s{k % 3}") for k in range(120)], "doc_id long, text string, source string")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == [*docs.columns, "mix_slot"] and sorted(mixed.select(*docs.columns).collect()) == sorted(docs.collect())
    want = {r.m_doc: r.slot for r in mixing.schedule(docs).collect()}
    assert {r.doc_id: r.mix_slot for r in mixed.collect()} == want
    assert sorted(r.doc_id for r in corpus_pipeline.pack_sequences(spark, mixed, "").collect()) == list(range(120))
