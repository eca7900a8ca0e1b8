"""Language fusion recomputed in plain Python; every placement of a packing against the rule itself."""

import collections
import math
import re

import numpy as np
import pytest

from voxloom.llm import langid, packing
from voxloom.llm.html_text import main_text

SF = "/root/testdata/sf0.001"


def plain_posterior(logs):
    e = [math.exp(x - max(logs)) for x in logs]
    return [x / sum(e) for x in e]


def plain_identify(pages, model):
    """``{page_id: (host, declared, suffix, lang, score)}`` by sums over dictionaries."""
    k, rows = len(model.langs), []
    for page_id, url, page in pages:
        m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        host = m[1].lower() if m else ""
        m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-zA-Z]{2})(?:[/?#-]|$)", url or "")
        suffix = m[1].lower() if m else host.rsplit(".", 1)[-1]
        m = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})", page or "")
        logs = model.logs(main_text(page)).tolist()
        rows.append((page_id, host, m[1].lower() if m else "", suffix, logs, plain_posterior(logs)))
    parent, top = lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1]
    sums = collections.defaultdict(lambda: np.zeros(k))
    for _, host, declared, suffix, _, p in rows:
        for name in (("all",), ("top", top(host)), ("parent", parent(host)), ("host", host), ("declared", declared), ("suffix", suffix)):
            sums[name] += p
    overall = (sums["all",] + 1) / (sums["all",] + 1).sum()

    def prior(host):
        q = overall
        for name in (("top", top(host)), ("parent", parent(host)), ("host", host)):
            q = (sums[name] + langid.PRIOR_WEIGHT * q) / (sums[name].sum() + langid.PRIOR_WEIGHT)
        return q

    belief = lambda name: np.log((sums[name] + langid.EVIDENCE_WEIGHT * overall) / overall)
    out = {}
    for page_id, host, declared, suffix, logs, _ in rows:
        fused = np.array(logs) + np.log(prior(host)) + (belief(("declared", declared)) if declared else 0) + (belief(("suffix", suffix)) if suffix else 0)
        post = plain_posterior(fused.tolist())
        out[page_id] = (host, declared or None, suffix if suffix in model.langs else None, model.langs[post.index(max(post))], max(post))
    return out


def test_fusion_equals_plain_sums(spark):
    model = langid.fit_text_model(spark.read.parquet(f"{SF}/documents.parquet"))
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    pages += [(1000, None, None), (1001, "", ""), (1002, "http://a.b.example.de/x", "<html lang='fr'><p>short</p>"), (1003, "http://b.example.de/fr/x", "<html><p>und so weiter und so fort</p>")]
    pages += [(1004 + i, "https://user@Host.Example.FR:80/es", "<html LANG=es><p>" + "le texte est en français et il est long " * (1 + i % 3) + "</p>") for i in range(20)]
    got = langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4), model).collect()
    want = plain_identify(pages, model)
    assert len(got) == len(pages) and len({w[3] for w in want.values()}) > 2
    for r in got:
        host, declared, suffix, lang, score = want[r.page_id]
        assert (r.host, r.declared, r.suffix_lang, r.lang) == (host, declared, suffix, lang)
        assert abs(r.score - score) < 1e-9


def plain_packing(lengths, capacity):
    """Each piece, longest first, where the sum of squares becomes smallest; ties to the smallest gap that remains."""
    bins, where, offset, touched = [], {}, {}, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        s, tried = lengths[i], []
        for g in sorted({b for b in bins if b >= s} | {capacity}):
            counts = collections.Counter(b for b in bins if 0 < b < capacity)
            if g < capacity:
                counts[g] -= 1
            if 0 < g - s < capacity:
                counts[g - s] += 1
            tried.append((sum(n * n for n in counts.values()), g - s, g))
        _, left, g = min(tried)
        # of the bins with that gap the one that got it last
        if g < capacity:
            at = next(b for b in reversed(touched) if bins[b] == g)
        else:
            at = len(bins)
            bins.append(capacity)
        touched.append(at)
        where[i], offset[i] = at, capacity - g
        bins[at] = left
    return [where[i] for i in range(len(lengths))], [offset[i] for i in range(len(lengths))], bins


@pytest.mark.parametrize(("seed", "capacity", "n"), [(1, 20, 60), (2, 7, 80), (3, 100, 70), (4, 3, 40)])
def test_every_placement_follows_the_rule(seed, capacity, n):
    lengths = np.random.default_rng(seed).integers(1, capacity + 1, n)
    where, offset, gaps = packing.sum_of_squares(lengths, capacity)
    want = plain_packing(lengths.tolist(), capacity)
    assert (where.tolist(), offset.tolist(), gaps.tolist()) == want
