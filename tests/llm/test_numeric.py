"""The parts that need no session, against plain versions."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import dartminhash, language, mixing, neardup, pfor, pieces, tokenfiles, warc, wordhash
from larkspur.llm.forest import Forest
from larkspur.llm.queries import tokenizer
from larkspur.llm.topk import pruned


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=700))
def test_pfor_round_trip(values):
    v = np.array(values, dtype=np.uint32)
    data = pfor.to_bytes([None, -5], np.array([len(v), 0]), v)
    keys, counts, back = pfor.from_bytes(data)
    assert keys == [None, -5] and counts.tolist() == [len(v), 0] and (back == v).all()
    s = pfor.sections(data)[3]
    for b in range(len(v) // pfor.BLOCK):
        assert (pfor.block(s, b) == v[b * pfor.BLOCK : (b + 1) * pfor.BLOCK]).all()


def test_pfor_outliers_go_to_exceptions():
    v = np.arange(256, dtype=np.uint32) % 8
    v[[3, 77]] = 2**32 - 1
    s = pfor.encode(v)
    assert s["width"].tolist() == [3] and s["place"].tolist() == [3, 77]
    with pytest.raises(ValueError):
        pfor.from_bytes(pfor.to_bytes([1], np.array([256]), v) + b"x")


def test_token_pieces_equal_the_library_on_whole_texts():
    own = tokenfiles.Encoder(tokenizer("byte_bpe_50k.json"), limit=300)
    random.seed(3)
    alphabet = " \n\t.,'!?aé1sл你Ġ-  \u0085"
    texts = ["", " ", "a  b", "\na b", "don't. you're!! 12", "a<|endoftext|>b <|endoftext|> c"]
    texts += ["".join(random.choices(alphabet, weights=[9] + [1] * (len(alphabet) - 1), k=random.randint(1, 40))) for _ in range(2000)]
    want = own.tokenizer.encode_batch(texts, add_special_tokens=False)
    for got, e, t in zip(own.encode(texts), want, texts, strict=True):
        assert got == np.array(e.ids, dtype="<u4").tobytes(), repr(t)


def test_period_stays_within_a_block_of_its_share():
    for shares in ({"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 501, "b": 250, "c": 248, "d": 1}, {"x": 5}):
        total, done = sum(shares.values()), dict.fromkeys(shares, 0)
        for t, s in enumerate(mixing.period(shares), 1):
            done[s] += 1
            for k, a in shares.items():
                assert abs(done[k] - t * a / total) < 1
        assert done == shares


def test_plan_places_every_block_once():
    random.seed(1)
    for _ in range(200):
        rows = {f"s{i}": random.randint(1, 60) for i in range(random.randint(1, 6))}
        parts = {s: random.randint(1, 5) for s in rows}
        slots, spans = [], []
        for s, _, first, n, base, at, period, own in mixing.plan(rows, parts, 4):
            for i in range(n):
                place = (i // len(own)) * period + own[i % len(own)]
                slots.append(base + place)
                size = min(4, rows[s] - (first + i) * 4)
                spans.append((at + place * 4, size))
        assert sorted(slots) == list(range(len(slots)))
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
    with pytest.raises(ValueError):
        mixing.shares({"a": 0.0})


def test_dart_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(0)
    for n, top in ((3, 1), (40, 9), (3000, 3)):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        w = r.integers(1, top + 1, len(a)).astype(float)
        w2 = np.maximum(1, w - (r.random(len(a)) < 0.3))
        both = dartminhash.similarity((a, w), (a, w2))
        same = (dartminhash.signature(a, w, 2048) == dartminhash.signature(a, w2, 2048)).mean()
        assert abs(both - same) < 0.05


def test_dart_signatures_take_weights_that_are_no_whole_numbers():
    a = np.arange(1, 50, dtype=np.uint64) * np.uint64(977)
    w, w2 = np.full(49, 0.7), np.full(49, 0.35)
    same = (dartminhash.signature(a, w, 2048) == dartminhash.signature(a, w2, 2048)).mean()
    assert abs(same - 0.5) < 0.05


def test_word_hashes_do_not_depend_on_the_batch():
    texts = ["Ein Wort, zwei", "", "été ÉTÉ", "...", "x" * 5000 + " y"]
    together, firsts = wordhash.word_hashes(texts)
    for i, t in enumerate(texts):
        alone, _ = wordhash.word_hashes([t])
        assert (together[firsts[i] : firsts[i + 1]] == alone).all()
    assert [int(b - a) for a, b in zip(firsts, firsts[1:], strict=False)] == [3, 0, 2, 0, 2]
    alike = wordhash.word_hashes(["été ÉTÉ"])[0]
    assert alike[0] == alike[1]


def test_shingles_of_short_texts():
    w = np.arange(3, dtype=np.uint64)
    assert len(wordhash.shingles(w, 5)) == 1 and len(wordhash.shingles(w[:0], 5)) == 0 and len(wordhash.shingles(np.arange(9, dtype=np.uint64), 5)) == 5


def test_pieces_are_lossless_and_do_not_depend_on_the_batch():
    own = pieces.lattice(tokenizer("piece_bpe_32k.model"))
    texts = [t.encode() for t in ["", "a", "  ", " a  b ", "▁x ▁", "hé\u0000\n\tz 你好 🎉🎉  end ", "x" * 3000, "the cat sat on the mat " * 30]]
    seeds = np.arange(len(texts), dtype=np.uint64)
    ids, at = own.sample(texts, seeds)
    for i, t in enumerate(texts):
        mine = ids[at[i] : at[i + 1]]
        assert own.decode(mine) == t
        again, _ = own.sample([t], seeds[i : i + 1])
        assert (again == mine).all()
    assert pieces.split_parts(b" a  b ") == [b" a", b"  b", b" "]


def test_pieces_are_sampled_in_proportion_to_all_ways_to_cut():
    own = pieces.lattice(tokenizer("piece_bpe_32k.model"))
    text = b" than"
    known = {s: i for i, s in enumerate(own.bytes) if len(s) > 1 or i not in set(own.byte_ids.tolist())}

    def weight(s):
        return float(own.slot_weight[np.flatnonzero(own.slot_id == known[s])[0]])

    ways = {(): 0.0}
    done = {}
    while ways:
        nxt = {}
        for cut, w in ways.items():
            used = sum(map(len, cut))
            for n in range(1, len(text) - used + 1):
                s = text[used : used + n]
                if s in known:
                    (done if used + n == len(text) else nxt)[(*cut, s)] = w + weight(s)
        ways = nxt
    total = sum(np.exp(w) for w in done.values())
    n = 20_000
    ids, at = own.sample([text] * n, wordhash.mix(np.arange(n, dtype=np.uint64)))
    seen = {}
    for a, b in zip(at, at[1:], strict=False):
        cut = tuple(own.bytes[i] for i in ids[a:b])
        seen[cut] = seen.get(cut, 0) + 1
    assert set(seen) <= set(done)
    for cut, w in done.items():
        assert abs(seen.get(cut, 0) / n - np.exp(w) / total) < 0.02


def test_language_scores_and_edge_cases():
    rows = [("en", *language.features(t)) for t in ["the cat and the dog", "this is that thing", "where there is the house", "with the others"] * 10]
    rows += [("de", *language.features(t)) for t in ["der hund und die katze", "das ist ein haus", "nicht mit der schule", "über und zurück"] * 10]
    model = language.fit(rows)
    assert model.predict("the thing that is there")[0] == "en" and model.predict("die schule und der hund")[0] == "de"
    assert model.predict(None) == model.predict("") == model.predict(" 12 !") == ("und", 0.0)
    assert 0 <= model.predict("zzz")[1] <= 1
    long = "der hund und " * 200_000
    assert model.predict(long)[0] == "de"
    assert language.fit([]).predict("abc") == ("und", 0.0)
    assert language.fit([("en", *language.features("abc"))]).predict("xyz") == ("en", 1.0)


def test_forest_routes_points_as_it_probes():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 8))
    f = Forest(x, 3, 4, 1)
    leaves = f.leaves(x)
    for i in range(0, 500, 50):
        found = f.probes(x[i], 48)
        assert len(set(found)) == 48
        assert {(t, int(leaves[i, t])) for t in range(3)} <= set(f.probes(x[i], 3)) | set(found[:12])
    same = Forest(np.ones((20, 4)), 2, 3, 1)
    assert same.leaves(np.ones((2, 4))).shape == (2, 2)


def test_pruned_search_equals_brute_force_with_ties():
    r = np.random.default_rng(4)
    v = r.integers(-3, 4, (700, 4)).astype(float)
    ids = r.permutation(700)
    q = v[:40]
    row, worse, near = pruned(v, ids, q, ids[:40], 5)
    for i in range(40):
        score = v @ q[i]
        score[i] = -np.inf
        best = np.lexsort((ids, -score))[:5]
        assert sorted(near[row == i].tolist()) == sorted(ids[best].tolist())
        assert sorted((-worse[row == i]).tolist()) == sorted(score[best].tolist())


def test_pruned_search_with_weights_beyond_double_precision():
    v = np.array([[2.0**40, 1.0], [2.0**40, 2.0], [-(2.0**40), 0.0]])
    row, worse, near = pruned(v, np.arange(3), v[:1], np.array([0]), 5)
    assert near.tolist() == [1, 2] and [-int(w) for w in worse] == [2**80 + 2, -(2**80)]


def test_page_text_and_records():
    page = '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- x --><p>one<br>t<b>w</b>o &lt;b&gt;</p><a href=\'/u?a&amp;b\'>link</a></body></html>'
    assert warc.parsed(page)[1] == "A & B\none\ntwo <b>\nlink"
    meta, text = warc.derived(3, "<urn:uuid:1>", "http://x/", "2020-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nServer: s\r\n\r\n", page.encode())
    fields = dict(line.split(": ", 1) for line in meta[8].decode().strip().split("\r\n"))
    assert fields["title"] == "A & B" and fields["languages-html"] == "fr" and fields["outlink"] == "/u?a&b"
    assert {h["name"]: h["value"] for h in text[7]}["WARC-Source-Content-Type"] == "text/html" and text[3] == "<urn:uuid:1>"
    assert warc.digest(b"") == "sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert warc.parsed("")[1] == "" and warc.parsed("<p>unclosed <b")[1] == "unclosed"
    assert zlib.crc32(b"a") == 0xE8B7BE43


def test_near_duplicate_sets_weigh_repeats():
    a, b = list(neardup.weighted_sets(["a b c d e " * 3, "a b c d e"], 5))
    assert a[1].sum() == 11 and b[1].sum() == 1
