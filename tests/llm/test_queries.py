"""The thin queries against the words of their contract, on small tables."""

import hashlib
import re
import zlib

import pytest

from lectern.llm import queries
from tests.llm.test_repeats import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1_fingerprints_and_components(spark, docs):
    from xxhash import xxh64_intdigest

    prints = {}
    for k, text in docs.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxh64_intdigest(x, 42) for x in shingles]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {k: k for k in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            low = min(root[b] for b in docs if (prints[a] ^ prints[b]).bit_count() <= 2)
            changed, root[a] = changed or low != root[a], low
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF).collect()}
    assert got == {k: (f"{prints[k]:016x}", root[k]) for k in docs}


def test_op3_pieces(spark, docs):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(queries.word_vocabulary())
    ids = {k: [*full.encode(t, add_special_tokens=False).ids, 2] for k, t in docs.items()}
    rows = queries.op3_packing(spark, SF).collect()
    at, filled = dict.fromkeys(docs, 0), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        at[r.doc_id] += r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {k: len(x) for k, x in ids.items()}
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert sum(map(len, ids.values())) > 0.9 * 4096 * (len(filled) - 1)


def test_op8_counts_and_digests(spark, tmp_path):
    rows = [(1, "é" * 150 + "x" * 250), (2, "y" + "x" * 230), (3, None), (4, "short"), (4, "short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op8_repeats(spark, str(tmp_path)).collect())
    assert got == sorted((k, n, sum(z - a for a, z in spans), len(spans), hashlib.sha256(kept).hexdigest()) for k, n, spans, kept in brute(rows))
