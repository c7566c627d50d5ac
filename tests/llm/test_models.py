"""What the learned models and random draws give, against plain loops over the same model or draws."""

import math
import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest

from cohortspark.llm import bytesops, langid, mixing, quality, toxicity
from cohortspark.llm.common import pack

LATIN = {c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7}


def plain_total(word, by, opening=None):
    """The probability of a word over all segmentations, by exact decimals."""
    sums = [Decimal(1)] + [Decimal(0)] * len(word)
    for end in range(1, len(word) + 1):
        for begin in range(end):
            piece = word[begin:end]
            sums[end] += sums[begin] * (by.get(piece, 0) + (opening or {}).get(piece, 0) * (begin == 0))
    return sums[-1]


@pytest.mark.parametrize("short", [32, 2])
def test_forward_sums_all_segmentations(monkeypatch, short):
    monkeypatch.setattr(langid, "SHORT", short)
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", b"ab" * 10]
    keys = np.sort(langid._keys(pieces))
    p = np.random.default_rng(0).dirichlet(np.ones(len(pieces))) * 1e-3
    by = {x: Decimal(float(p[np.searchsorted(keys, langid._keys([x])[0])])) for x in pieces}
    text = [b"abab", b"b", b"ab" * 10, b"ab" * 11, b"ababab", b"aa", b"ab" * 250, b"abb" * 300]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in text])])
    words = langid.Words(np.frombuffer(b"".join(text), np.uint8), bounds[:-1], bounds[1:], bytesops.Keys(keys), 20)
    assert np.allclose(words.log_probability(p), [float(plain_total(t, by).ln()) for t in text], rtol=1e-9)
    uses = words.expected(p, np.ones(len(text)))
    assert math.isclose(sum(uses[np.searchsorted(keys, langid._keys([x])[0])] * len(x) for x in pieces), sum(map(len, text)), rel_tol=1e-9)


def test_vocabulary_is_whole():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=langid.VOCABULARY)
    keys, longest = langid.vocabulary()
    bodies = [model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    assert longest == max(len(b.lstrip("▁").encode()) for b in bodies)
    inner = [b.encode() for b in bodies if b[0] != "▁"]
    assert np.isin(langid._keys(inner), keys).all()


def test_document_scores_by_plain_sums(spark):
    r = random.Random(1)
    pieces = [bytes([b]) for b in range(256)] + [b"the", b"er", b"sch", b"un", b"house", "schön".encode()]
    keys, opening = np.unique(langid._keys(pieces)), [b"the", b"un"]
    every = np.unique(np.concatenate([keys, langid._keys(opening) ^ langid._START]))
    p = np.random.default_rng(2).dirichlet(np.ones(len(every)), 2).astype(np.float32)
    model = pack(keys=every, longest=np.array(6), p=p, langs=np.array(["de", "en"]))
    value = lambda k, x, start=np.uint64(0): Decimal(float(p[k][np.searchsorted(every, langid._keys([x])[0] ^ start)]))
    tables = [({x: value(k, x) for x in pieces}, {x: value(k, x, langid._START) for x in opening}) for k in range(2)]
    words = ["the", "UNDER", "schön", "HOUSE", "Ünder", "a" * 70]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 3)))) for i in range(12)] + [(50, None), (51, "12"), (52, "")]
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        found = re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").translate(LATIN).encode())
        if not found:
            assert got[i] == ("und", 0.0)
            continue
        logs = [sum(plain_total(w, *t).ln() for w in found) for t in tables]
        assert got[i][0] == ("de" if logs[0] >= logs[1] else "en")
        assert math.isclose(got[i][1], float(1 / sum((x - max(logs)).exp() for x in logs)), rel_tol=1e-6)


def test_factorization_scores_are_pair_sums(spark):
    text = "You Rotten fool, the fools are rotten and ÄRGER"
    data = np.frombuffer(text.encode(), np.uint8)
    known = np.unique(toxicity.terms(data, np.array([0, len(data)]))[0])[::2]
    r = np.random.default_rng(3)
    w, v = r.normal(0, 1, len(known)), r.normal(0, 0.3, (len(known), 4))
    rows = [(1, text), (2, "rotten"), (3, None), (4, "you YOU you"), (5, " ".join([text] * 50))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in toxicity.score(frame, pack(keys=known, w=w, v=v, b=np.array(-0.4))).collect()}
    hash_of = lambda term: int(bytesops.span_hash(bytesops.prefix_hash(np.frombuffer(term, np.uint8)), np.array([0]), np.array([len(term)]))[0])
    for i, t in rows:
        present = set()
        for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").translate(LATIN).encode()):
            present.add(hash_of(word))
            present |= {int(bytesops.mix(np.array([hash_of(word[:n]) + n & (1 << 64) - 1], np.uint64))[0]) for n in (3, 4, 5, 6) if len(word) > n}
        at = [k for k in range(len(known)) if int(known[k]) in present]
        z = -0.4 + sum(w[a] for a in at) + sum(float(v[a] @ v[b]) for a in at for b in at if a < b)
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-9), t


def small_network(seed=5):
    r = np.random.default_rng(seed)
    shape = {"tables": (quality.WIDTH, quality.PAD + 1, quality.FILTERS), "w1": (quality.FILTERS, quality.HIDDEN), "b1": (quality.HIDDEN,), "w2": (quality.HIDDEN,), "b2": (), "mixture": (3,), "bias": ()}
    return {k: np.asarray(r.normal(0, 0.4, v)) for k, v in shape.items()}


def plain_logit(text, m):
    z, at = [], 0
    while True:
        codes = [*text[at : at + quality.CHUNK], *[quality.PAD] * quality.CHUNK][: quality.CHUNK]
        pooled = [max(sum(m["tables"][j][codes[x + j]][f] for j in range(quality.WIDTH)) for x in range(quality.CHUNK - quality.WIDTH + 1)) for f in range(quality.FILTERS)]
        hidden = [max(0, sum(pooled[f] * m["w1"][f][h] for f in range(quality.FILTERS)) + m["b1"][h]) for h in range(quality.HIDDEN)]
        z.append(sum(hidden[h] * m["w2"][h] for h in range(quality.HIDDEN)) + m["b2"])
        if at + quality.CHUNK >= len(text):
            return m["mixture"] @ [sum(z) / len(z), max(z), min(z)] + m["bias"]
        at += quality.STRIDE


def test_network_scores_by_plain_loops(spark):
    m, r = small_network(), random.Random(2)
    rows = [(i, "".join(r.choice("abc é\n") for _ in range(n))) for i, n in enumerate((0, 3, 255, 257, 700))] + [(9, None)]
    got = {x["doc_id"]: x["score"] for x in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), pack(**m)).collect()}
    for i, t in rows:
        assert math.isclose(got[i], 1 / (1 + math.exp(-plain_logit((t or "").encode(), m))), rel_tol=1e-9), i


def test_network_gradient_by_differences():
    m, r = small_network(), np.random.default_rng(6)
    bounds = np.array([0, 40, 900])
    codes, row = quality.layout(r.integers(97, 123, 900).astype(np.uint8), bounds)
    error = np.array([0.3, -0.7])
    grads = quality._backward(codes, row, quality.forward(codes, row, 2, m), error, m)
    for name, value in m.items():
        place = np.unravel_index(np.abs(grads[name]).argmax(), value.shape)
        for sign in (1, -1):
            moved = {**m, name: value.copy()}
            moved[name][place] += sign * 1e-6
            logit = quality.forward(codes, row, 2, moved)["logit"] @ error
            up, down = (logit, down) if sign < 0 else (None, logit)
        assert math.isclose((down - up) / 2e-6, grads[name][place], rel_tol=1e-4, abs_tol=1e-7), name


def plain_mix(docs, draws):
    """One source's copies by sequential pivots, largest documents first, with draws from a plain generator."""
    todo, taken = [[n, f] for n, f in sorted(docs, reverse=True)], 0.0
    carry = None
    for item in todo:
        if carry is None:
            carry = item
            continue
        (a, f), (b, g) = carry, item
        up, down = min((1 - f) * a, g * b), min(f * a, (1 - g) * b)
        move = up if draws.random() * (up + down) < down else -down
        carry, item = [a, f + move / a], [b, g - move / b]
        done, carry = (carry, item) if min(carry[1], 1 - carry[1]) < 1e-9 else (item, carry)
        taken += round(done[1]) * done[0]
    return taken + carry[0] * (draws.random() < carry[1])


def test_mixing_keeps_targets_beside_a_huge_text(spark):
    r = random.Random(3)
    rows = [(i, "w " * (30 + r.randint(0, 400)), "ab"[i % 2]) for i in range(1500)] + [(9000, "w " * 60000, "a"), (9001, "w " * 9000, "b"), (9002, None, "a"), (9003, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (1, 2, 3):
        out = mixing.mix(frame, seed=seed).collect()
        assert len(out) == len(rows) and all(x["copies"] in (math.floor(x["target"] / max(1, x["source_size"])), math.floor(x["target"] / max(1, x["source_size"])) + 1) for x in out if x["size"])
        by = defaultdict(list)
        for x in out:
            by[x["source"]].append(x)
        for x in (by["a"], by["b"]):
            middle = np.median([y["size"] for y in x])
            assert abs(sum(y["taken"] for y in x) - x[0]["target"]) <= middle
            # a plain sequential rounding of the same documents comes to the same total, as near as its last document
            rate = x[0]["target"] / x[0]["source_size"]
            plain = sum(math.floor(rate) * y["size"] for y in x) + plain_mix([(y["size"], rate % 1) for y in x if y["size"]], random.Random(seed))
            assert abs(plain - x[0]["target"]) <= max(y["size"] for y in x)


def test_mixing_hands_down_without_bias(spark):
    """Over many sources alike, each size gets its share of copies: large documents too."""
    rows = [(s * 100 + i, "w " * n, f"s{s:03d}") for s in range(120) for i, n in enumerate((4000, 300, 200, 40, 30, 20, 9, 5))]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(2, 3)).collect()
    by = defaultdict(list)
    for x in out:
        by[x["target"] > x["source_size"], x["size"]].append(x["copies"] - x["target"] / x["source_size"])
    assert all(abs(np.mean(x)) < 0.2 for x in by.values()), {k: np.mean(v) for k, v in by.items()}
    assert Counter(x["doc_id"] for x in out) == Counter(x[0] for x in rows)


def test_language_stage_rejects_gibberish_and_unlearned_languages(spark):
    from cohortspark.llm import langid

    r = random.Random(8)
    en, de = ["the", "of", "and", "thing", "other", "houses", "under", "water", "green"], ["der", "und", "haus", "wasser", "unter", "nicht", "kinder", "baum", "auch"]
    say = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    rows = [(k, say(en if k % 2 else de, r.choice([2, 5, 40, 200])), "en" if k % 2 else "de") for k in range(300)]
    learned = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(learned)
    odd = {
        1000: "qzx vkj wqpf bnmk zzxq hjkl", 1001: "Kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan", 1002: "Всички хора се раждат", 1003: "12 34 !!", 1004: None, 1005: "",
        1006: "qzxv wkjq " * 3000, 1010: "the", 1011: "und der", 1012: "the water " * 3000, 1013: "The Water of the houses",
    }
    docs = learned.unionByName(spark.createDataFrame([(k, t, None) for k, t in odd.items()], "doc_id long, text string, lang string"))
    kept = [x["doc_id"] for x in langid.keep_identified(docs, model).collect()]
    assert sorted(kept) == [*range(300), 1010, 1011, 1012, 1013]
