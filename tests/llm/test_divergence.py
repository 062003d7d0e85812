"""The audit against sums over all terms in Python's integers; the tree against single pairs."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import divergence

SF = "/root/testdata/sf0.001"


def plain_audit(rows, least=10, top=10):
    """rows: (text, lang, source)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", x or "", s or "") for t, x, s in rows):
        low = text.translate({c: c + 32 for c in range(65, 91)})
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(Counter({t: counts[lang, s][t] for t in kept})) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, n + 1) for part, found in (("pair", pairs), ("term", terms)) for n, (v, _, item) in enumerate(found)]
    return sorted(out)


def test_audit_equals_plain_sums(spark):
    real = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [(None, "en", "src0"), ("", "en", "hollow"), ("1 2 [\\]^_`{|}~\x7f@", None, None), ("Épée ÉPÉE épée ſ K", "fr", "src1"), ("lone lone", "xx", "a"), ("lone", "xx", "b"), ("word " * 4000, "en", "src1")]
    odd += [("Alpha beta ALPHA", "yy", s) for s in "abc" * 6] + [("beta gamma", "yy", "c")] * 12 + [("solo solo", "zz", "only")] * 11
    df = spark.createDataFrame(real + odd, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit(2), "docs": F.lit("d"), "place": F.lit(0)})
    got = divergence.audit(df.repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(real + odd)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shared_paths_meet_once_and_sums_are_those_of_single_terms():
    rng = np.random.default_rng(5)
    rows = sorted({tuple((s, int(rng.integers(1, 4)) * 1000 + s) for s in range(7) if rng.random() < 0.6) for _ in range(150)} - {()})
    times = rng.integers(1, 5, len(rows))
    flat = np.array([x for r in rows for x in r], np.int64)
    starts = np.r_[0, np.cumsum([len(r) for r in rows])]
    zero = flat[:, 0] * 10 + 50
    a, b, v = divergence.tree_corrections(starts, flat[:, 0], flat[:, 1], zero, times)
    f = lambda x, y: (x - y) ** 2 // (x + y)
    want = Counter()
    for r, n in zip(rows, times.tolist(), strict=True):
        for (s, p), (t, q) in combinations(r, 2):
            p0, q0 = s * 10 + 50, t * 10 + 50
            want[s, t] += n * (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))
    assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), v.tolist(), strict=True)) == dict(want)
    none = np.empty(0, np.int64)
    assert all(len(x) == 0 for x in divergence.tree_corrections(np.zeros(1, np.int64), none, none, none, none))
