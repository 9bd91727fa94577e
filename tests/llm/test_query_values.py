"""What registered queries without a statement return, against plain Python on the smallest tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import tiktoken
import xxhash

from seedscape.llm import pii
from seedscape.llm.queries import PATTERN, PSEUDONYM_KEY, QUERIES, RANKS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(rows):
    """Token ids of every document, by the library."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {i: encoding.encode_ordinary(t or "") for i, t in rows.items()}


def test_shards(spark, rows):
    made = QUERIES["op1_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in made) == sorted(rows)
    slots, load = defaultdict(list), Counter()
    for r in made:
        text = rows[r.doc_id]
        assert r.size == len((text or "").encode()) + 1
        assert r.text_crc32 == (None if text is None else zlib.crc32(text.encode()))
        assert (r.law, r.grown_shard) == ("bytes", None)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(load.values()) / 8
    assert max(load.values()) - min(load.values()) <= 2 * max(r.size for r in made) + share / 64


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def test_fingerprints_and_components(spark, rows):
    codes = {i: _fingerprint(t) for i, t in rows.items()}
    root = {i: i for i in codes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(codes)
    for k, b in enumerate(order):
        for a in order[:k]:
            if (codes[a] ^ codes[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    made = QUERIES["op2_simhash_near_dedup"](spark, SF).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in made) == [(i, f"{codes[i]:016x}", find(i)) for i in order]


def test_length_histogram(spark, ids):
    lengths = Counter(map(len, ids.values()))
    total, tokens = sum(lengths.values()), sum(n * k for n, k in lengths.items())
    made = QUERIES["op4_token_counts"](spark, SF).collect()
    assert {r.n_tokens: r.n_docs for r in made} == lengths
    for r in made:
        kept = sum(min(n, r.n_tokens) * k for n, k in lengths.items())
        longer = sum(k for n, k in lengths.items() if n > r.n_tokens)
        assert (r.docs_total, r.tokens_total) == (total, tokens)
        assert (r.kept_tokens, r.cut_tokens, r.cut_docs) == (kept, tokens - kept, longer)
        assert r.quantile == pytest.approx((total - longer) / total)


def test_encoding(spark, rows, ids):
    digest = lambda b: hashlib.sha256(b).hexdigest()
    wanted = [(i, len(x), digest(",".join(map(str, x)).encode()), digest((rows[i] or "").encode())) for i, x in ids.items()]
    assert sorted(tuple(r) for r in QUERIES["op5_bpe"](spark, SF).collect()) == sorted(wanted)


def test_pseudonyms_go_back(spark, rows):
    made = QUERIES["op8_pii"](spark, SF)
    back = {r.doc_id: r.text for r in pii.pseudonymize(made.select("doc_id", "text"), PSEUDONYM_KEY, restore=True).collect()}
    assert back == rows
    found = made.collect()
    assert any(r.n_replaced for r in found) and all((r.text == rows[r.doc_id]) or r.n_replaced for r in found)
    assert all(r.n_replaced == len(list(filter(None, (r.kinds or "").split(",")))) for r in found)


def test_repeated_bytes(spark, rows):
    seen, wanted = set(), []
    for i in sorted(rows):
        text = (rows[i] or "").encode()
        gone = bytearray(len(text))
        for at in range(len(text) - 99):
            window = text[at : at + 100]
            if window in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        wanted.append((i, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    made = QUERIES["op10_suffix_dedup"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r) for r in made.collect()) == wanted
