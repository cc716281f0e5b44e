"""Parts that need no Spark, against plain definitions."""

import random

import numpy as np
import pytest

from framelake.llm import bpe, chat, jaccard, neighbours, ngrams, secrets, suffixes, toxicity

WORDS = "the of an erin thand ithe lowei password token = 24be64439e3e49cf46b2d7c90f3602a3 İΣ ΑΣ ﬁ 漢字 don't I'LL 12½² é é 😀👍 <|endoftext|> \x1c \x85".split(" ")


def test_bpe_is_that_of_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary_path()
    library = tokenizers.Tokenizer.from_file(path)
    encoder = bpe.Encoder(bpe.load(path))
    rng = random.Random(3)
    letters = "aeithnorsd" * 5 + "éñß'.!0_Z漢"
    texts = ["", " ", "aaaa" * 400, " x y", *(" ".join(rng.choices(WORDS, k=12)) for _ in range(40))]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(400)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        raw = encoder.encode(text)
        assert np.frombuffer(raw, np.uint32).tolist() == ids, text
        assert encoder.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False).encode(), text


def test_backtracking_is_merging():
    v = bpe.load(bpe.vocabulary_path())
    encoder, rng = bpe.Encoder(v), random.Random(5)
    for _ in range(400):
        word = "".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 24)))
        symbols = word[:-1] + chr(256 + ord(word[-1]))
        assert encoder.word(symbols) == v.by_merging(symbols)


def test_secret_spans():
    text = 'x PASSWORD : "abcdefgh" AKIA' + "B" * 12 + " token=short " + "0a" * 20 + " api_key=1234567890 AKIAZZ"
    spans = secrets.base_spans(text)
    assert [secrets.KINDS[k] for _, k, _ in spans] == ["assign", "access", "hex", "assign"]
    assert text[spans[0][0] : spans[0][2]] == 'PASSWORD : "abcdefgh' and text[spans[2][0] : spans[2][2]] == "0a" * 20
    assert secrets.base_spans("tokeN=Key12345678") == []  # the Kelvin sign is no k
    assert secrets.known("0a" * 20) and secrets.known("123e4567-e89b-12d3-a456-426614174000") and not secrets.known("0a" * 19)
    assert secrets.listed(spans).startswith("assign:2:") and secrets.base_spans("") == []


@pytest.mark.parametrize("length", [5, 10**9])
def test_suffix_order(length):
    rng = random.Random(length)
    for _ in range(200):
        t = np.array([rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 60))], np.int64)
        order = suffixes.suffix_order(t, length)
        keys = [t[i : i + length].tolist() for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(t)))


def brute_chat(roles, state=chat.NOTHING, at=0):
    if at == len(roles):
        return chat.end_cost(state)[0]
    return min(c + brute_chat(roles, t, at + 1) for c, t, _, _ in chat.STEPS[state, roles[at]])


def test_chat_repair_is_cheapest_by_chunks():
    rng = random.Random(9)
    for _ in range(60):
        roles = [rng.choice([-1, 0, 1, 2]) for _ in range(rng.randint(1, 7))]
        cuts = sorted(rng.sample(range(1, len(roles)), min(len(roles) - 1, 2))) if len(roles) > 1 else []
        chunks = [roles[a:b] for a, b in zip([0, *cuts], [*cuts, len(roles)])]
        way = chat.way([chat.chunk_matrix(c) for c in chunks])
        steps = [s for c, (a, b) in zip(chunks, way) for s in chat.trace(c, a, b)]
        assert sum(s[0] for s in steps) + chat.end_cost(steps[-1][1])[0] == brute_chat(roles)


def test_legal_chat_stays():
    roles = [0, 1, 2, 1, 2]
    assert [s[2] for s in chat.trace(roles, *chat.way([chat.chunk_matrix(roles)])[0])] == ["keep"] * 5


def test_nearest_is_exact():
    rng = np.random.default_rng(2)
    q, c = rng.standard_normal((7, 33)), rng.standard_normal((300, 33)) * rng.gamma(1, 1, (300, 1))
    c[10] = c[11]
    found = dict(neighbours.nearest(np.arange(7), q, np.arange(100, 400), c, 5))
    for i in range(7):
        d = neighbours.distances(q[i], c)
        assert [j for _, j in found[i]] == [int(j) + 100 for j in np.lexsort((np.arange(300), d))[:5]]


def near_by_sorting(q, c, k):
    return [[int(j) for j in np.lexsort((np.arange(len(c)), neighbours.distances(x, c)))[:k]] for x in q]


def test_nearest_is_exact_where_rounding_is_large():
    rng = np.random.default_rng(4)
    line = rng.choice([-1.0, 1.0], 16)
    cases = {
        "far from the origin": 1000 + rng.uniform(0, 1e-5, (200, 1)),
        "on a line": line * (1 + rng.uniform(0, 1e-7, (200, 1))),
        "signs": rng.choice([-1.0, 1.0], (200, 16)),
        "large and small": rng.standard_normal((200, 8)) * 10.0 ** rng.integers(-12, 12, (200, 1)),
        "huge": rng.standard_normal((200, 4)) * 1e160,
        "tiny": rng.standard_normal((200, 4)) * 1e-310,
        "offset": 1e6 + rng.standard_normal((200, 8)) * 1e-4,
    }
    for name, v in cases.items():
        with np.errstate(all="ignore"):
            found = dict(neighbours.nearest(np.arange(1000, 1150), v[:150], np.arange(200), v, 5))
            assert [[j for _, j in found[i]] for i in range(150)] == near_by_sorting(v[:150], v, 5), name


def chat_ways(roles):
    """All legal sequences that keep, relabel, merge and insert, by a plain search over (turns left, last role), without the tables of the operator."""
    follows = {None: (0, 1), 0: (1,), 1: (2,), 2: (1,)}

    def cost(at, last):
        ends = 0.0 if last in (None, 2) else chat.INSERT if last == 1 else 2 * chat.INSERT
        best = ends if at == len(roles) else chat.INF
        if at < len(roles):
            r = roles[at]
            for new in range(3):
                change = 0.0 if new == r else chat.UNKNOWN if r < 0 else chat.RELABEL
                if new in follows[last]:
                    best = min(best, change + cost(at + 1, new))
                else:  # a turn between, if one makes it legal
                    for between in (1, 2):
                        if between in follows[last] and new in follows[between]:
                            best = min(best, chat.INSERT + change + cost(at + 1, new))
            if last is not None:
                best = min(best, chat.MERGE + (0.0 if r == last else chat.UNKNOWN if r < 0 else chat.RELABEL) + cost(at + 1, last))
        return best

    return cost(0, None)


def test_chat_costs_by_a_search_of_its_own():
    rng = random.Random(10)
    for _ in range(80):
        roles = [rng.choice([-1, 0, 1, 2]) for _ in range(rng.randint(1, 6))]
        way = chat.way([chat.chunk_matrix(roles)])
        steps = chat.trace(roles, *way[0])
        assert sum(s[0] for s in steps) + chat.end_cost(steps[-1][1])[0] == chat_ways(roles), roles
        spelled = []
        for _, state, action, inserted in steps:
            spelled += inserted if action != chat.JOIN else ()
            spelled += [state - 1] if action != chat.JOIN else []
        spelled += chat.end_cost(steps[-1][1])[1]
        legal = spelled[1:] if spelled[:1] == [0] else spelled
        assert legal == [1, 2] * (len(legal) // 2)


def scored_one_by_one(w, text):
    """The score by the definition: word by word, window by window, with plain loops."""
    from zlib import crc32

    words = [x.strip(toxicity.SIGNS).encode() for x in text.lower().split()]
    if not words:
        return 0.0

    def embedded(word):
        marked = b"^" + word + b"$$"[: max(1, 3 - len(word))]
        grams = [int.from_bytes(marked[k : k + 4], "little") * 0x9E3779B97F4A7C15 % 2**64 >> 50 for k in range(len(marked) - 3)]
        mean = np.mean([w["char"][g] for g in grams], axis=0) if grams else np.zeros(toxicity.CHAR_DIMS)
        return np.concatenate([w["word"][crc32(word) % toxicity.BUCKETS], mean]).astype(float)

    s = lambda x: 1 / (1 + np.exp(-x))
    n, best = toxicity.HIDDEN, -np.inf
    last = max(0, -(-(len(words) - toxicity.WINDOW) // toxicity.STRIDE))
    for k in range(last + 1):
        x = [embedded(word) for word in words[k * toxicity.STRIDE : k * toxicity.STRIDE + toxicity.WINDOW]]
        states = {}
        for side, order in (("f", range(len(x))), ("b", reversed(range(len(x))))):
            h = np.zeros(n)
            for t in order:
                a, b = x[t] @ w["x" + side] + w["b" + side], h @ w["h" + side]
                z, r = s(a[:n] + b[:n]), s(a[n : 2 * n] + b[n : 2 * n])
                c = np.tanh(a[2 * n :] + r * b[2 * n :])
                h = z * h + (1 - z) * c
                states[side, t] = h
        both = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(len(x))])
        look = np.exp(both @ w["look"])
        best = max(best, float((look / look.sum()) @ both @ w["out"] + w["bias"][0]))
    return s(best)


def test_scores_are_those_of_the_definition():
    rng = random.Random(5)
    w = toxicity.new_weights(3)
    w = {k: v * 4 for k, v in w.items()}
    names = ["the", "of!", "Grobian", "é", "a", "x.y", "...", "longerword"]
    texts = [" ".join(rng.choices(names, k=n)) for n in (0, 1, 5, 23, 24, 25, 36, 37, 90)]
    with np.errstate(over="ignore"):
        assert np.allclose(toxicity.score_texts(w, texts), [scored_one_by_one(w, t) for t in texts], atol=1e-5)


def test_shared_counts_and_roots():
    rng = random.Random(4)
    sets = [np.unique(np.array(rng.choices(range(50), k=rng.randint(0, 30)), np.uint64)) for _ in range(20)]
    expected = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[5:]] for a in sets[:5]]
    assert jaccard.shared_counts(sets[:5], sets[5:]).tolist() == expected
    assert jaccard.roots(6, np.array([5, 4, 1]), np.array([4, 3, 0])).tolist() == [0, 0, 2, 3, 3, 3]


def test_bands_reach_the_recall():
    b = jaccard.bands_for(0.8, 0.9999, 5)
    assert 1 - (1 - 0.8**5) ** b >= 0.9999 > 1 - (1 - 0.8**5) ** (b - 1)


def test_gradients():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in toxicity.new_weights().items()}
    words, flat, lengths = toxicity.read(["a loweix! of the the", "Idiot ofen", "über ab"])
    _, first, size = toxicity.windows(lengths)
    at, mask = toxicity.gather(flat, first, size)
    mask, y = mask.astype(np.float64), np.array([1.0, 0, 1])
    _, g = toxicity.gradients(w, words, at, mask, y)
    for name in w:
        for _ in range(4):
            spot = tuple(rng.integers(0, n) for n in w[name].shape)
            if name == "word":
                spot = (int(rng.choice(words.word)), spot[1])
            if name == "char":
                spot = (int(rng.choice(words.grams)), spot[1])
            kept, step = w[name][spot], 1e-5
            w[name][spot] = kept + step
            up = toxicity.gradients(w, words, at, mask, y)[0]
            w[name][spot] = kept - step
            down = toxicity.gradients(w, words, at, mask, y)[0]
            w[name][spot] = kept
            assert abs((up - down) / (2 * step) - g[name][spot]) < 1e-6, (name, spot)


def test_windows_cover_all_words():
    lengths = np.array([0, 1, 24, 25, 100])
    text, first, size = toxicity.windows(lengths)
    begin = np.cumsum(lengths) - lengths
    for k, n in enumerate(lengths):
        covered = {i for t, f, s in zip(text, first, size) if t == k for i in range(f, f + s)}
        assert covered == set(range(begin[k], begin[k] + n))


def test_training_tells_words_apart():
    rng = random.Random(6)
    plain = "the of and erin thand oust ble ndea in re".split()
    texts = [" ".join(rng.choices(plain, k=40)) for _ in range(160)]
    toxic = np.array([k % 2 for k in range(160)])
    texts = [t + (" grobian! " + " ".join(rng.choices(plain, k=30)) if y else "") for t, y in zip(texts, toxic)]
    w = toxicity.fit(texts, toxic)
    found = toxicity.score_texts(w, [*texts[:40], "", "  "])
    assert ((found[:40] >= 0.7) == toxic[:40]).mean() > 0.95 and found[40:].tolist() == [0, 0]
    assert toxicity.fit(["a"], np.array([1])) == 1.0 and toxicity.fit([], np.array([])) == 0.0


def test_tokens_of_texts():
    tokens, before, lengths = ngrams.tokens_of(["A b".encode(), b"", "Á b\x0bc".encode()])
    assert lengths.tolist() == [3, 1, 3] and tokens[2] == tokens[3] == ngrams.END and before[0] == before[3] == ngrams.START
