"""Plain versions of toxicity learning and scoring, and of multiway differencing, held against the operators."""

import math
import random
import sys
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from playframe.llm import packing, toxicity


def plain_lexicon(docs):
    """Log-odds with a Dirichlet prior from the definition; docs are (label, text), each of weight 1."""
    counts = {0: Counter(), 1: Counter()}
    for y, text in docs:
        counts[y].update({u for t in set(toxicity.TOKEN.findall(text.lower())) for u in [t + ".", *(t[:k] for k in toxicity.PREFIXES if len(t) >= k)]})
    total = {y: sum(c.values()) for y, c in counts.items()}
    out = {}
    for unit in counts[0] | counts[1]:
        n = {y: counts[y][unit] for y in (0, 1)}
        prior = toxicity.PRIOR * (n[0] + n[1])
        mass = toxicity.PRIOR * (total[0] + total[1])
        odds = {y: math.log((n[y] + prior) / (total[y] + mass - n[y] - prior)) for y in (0, 1)}
        z = (odds[1] - odds[0]) / math.sqrt(1 / (n[1] + prior) + 1 / (n[0] + prior))
        if abs(odds[1] - odds[0]) >= toxicity.MIN_EFFECT and abs(z) >= toxicity.MIN_Z:
            out[unit] = odds[1] - odds[0]
    return out


def best_segments(scores):
    """All maximal scoring segments by recursion on the best one."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[0] + 1e-12):
                best = (total, i, j)
    if best is None:
        return []
    _, i, j = best
    return best_segments(scores[:i]) + [best[0]] + best_segments(scores[j + 1 :])


def corpus():
    rng = random.Random(3)
    words = [f"calm{i}word" for i in range(60)]
    docs = []
    for i in range(300):
        text = rng.choices(words, k=rng.randint(8, 40))
        y = int(i % 4 == 0)
        if y:
            at = rng.randrange(len(text))
            text[at:at] = rng.sample(["vileness", "vileword", "nastything", "horridly"], 3)
        docs.append((i, y, " ".join(text)))
    return docs


def test_learning_and_scoring_equal_the_plain_version(spark):
    docs = corpus()
    frame = spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y, _ in docs], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    kept = {r.doc_id for r in labels.where(~toxicity.held_out("doc_id")).collect()}
    want = plain_lexicon([(y, t) for i, y, t in docs if i in kept])
    assert model.lexicon.keys() == want.keys() and all(math.isclose(model.lexicon[u], want[u], rel_tol=1e-5) for u in want)
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    for i, _, text in docs[:60]:
        tokens = toxicity.TOKEN.findall(text.lower())
        scores = []
        for t in tokens:
            known = next((model.lexicon[u] for u in [t + ".", *(t[:k] for k in sorted(toxicity.PREFIXES, reverse=True) if len(t) >= k)] if u in model.lexicon), None)
            scores.append(-toxicity.DRIFT if not known else known)
        e = sum(max(0.0, -math.log(len(tokens) * math.exp(model.log_k - model.decay * s))) for s in best_segments(scores))
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.base + model.slope * e))))
        assert math.isclose(got[i], p, rel_tol=1e-6, abs_tol=1e-9)
    wrong = sum((got[i] >= 0.5) != bool(y) for i, y, _ in docs if i not in kept)
    assert wrong <= 2


def test_copies_of_one_text_weigh_as_one(spark):
    docs = corpus()
    copies = docs + [(1000 + i, docs[0][1], docs[0][2]) for i in range(150)]
    models = [toxicity.fit(spark.createDataFrame([(i, t) for i, _, t in d], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, y, _ in d], "doc_id long, toxic int")) for d in (docs, copies)]
    held = [u for u in models[0].lexicon if not math.isclose(models[0].lexicon[u], models[1].lexicon.get(u, 0), abs_tol=0.05)]
    assert not held


def plain_differencing(sizes, windows):
    """Largest differencing on whole lists of sums, padded with empty windows; sums of the windows in falling order."""
    parts = [[s] + [0] * (windows - 1) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return parts[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=40, unique=True), st.integers(1, 8))
def test_differencing_is_as_even_as_the_plain_version(sizes, windows):
    got = sorted((sum(sizes[i] for i in w) for w in packing.differencing(sizes, windows)), reverse=True)
    assert sum(got) == sum(sizes) and len(got) <= windows
    want = plain_differencing(sizes, windows)
    assert max(got) <= max(want) * 1.25 + 1  # ties between spreads may merge in another order


@pytest.mark.parametrize(("sizes", "windows", "want"), [([8, 7, 6, 5, 4], 2, [16, 14]), ([4, 5, 6, 7, 8], 3, [11, 11, 8])])
def test_known_differencings(sizes, windows, want):
    assert sorted((sum(sizes[i] for i in w) for w in packing.differencing(sizes, windows)), reverse=True) == want


def test_windows_never_exceed_the_capacity():
    rng = random.Random(9)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 60))]
        windows = packing.windows_of(sizes, 100)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= 100 for w in windows)
        assert len(windows) <= -(-sum(sizes) // 100) * 2


def lines_run(hits):
    """How many lines the scan executes."""
    n = 0

    def trace(frame, event, arg):
        nonlocal n
        n += event == "line"
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        toxicity.maximal_segments(hits)
    finally:
        sys.settrace(before)
    return n


@pytest.mark.parametrize("kind", ["isolated", "rising", "falling", "mixed"])
def test_the_scan_is_linear(kind):
    rng = random.Random(4)
    make = {
        "isolated": lambda n: [(50 * i, 2.0) for i in range(n)],
        "rising": lambda n: [(2 * i, 1.0 + i / n) for i in range(n)],
        "falling": lambda n: [(i, 1.0 if i % 2 else -1.5) for i in range(n)],
        "mixed": lambda n: [(3 * i, rng.uniform(-2, 2)) for i in range(n)],
    }[kind]
    assert lines_run(make(20_000)) <= 4.3 * lines_run(make(5_000))


@pytest.mark.parametrize("seed", range(3))
def test_scan_equals_recursion_on_the_best(seed):
    rng = random.Random(seed)
    for _ in range(200):
        scores = [rng.choice([-0.05, -0.05, rng.uniform(-2, 2)]) for _ in range(rng.randint(1, 40))]
        got = [s for *_, s in toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s != -0.05])]
        assert got == pytest.approx(best_segments(scores))
