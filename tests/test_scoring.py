"""Stage scores and distributed matching against plain loops over random documents."""

import json
import re

import numpy as np
import pytest

from loomspark.operators import payload, relational
from loomspark.operators import scoring as S

RNG = np.random.default_rng(4)
pick = lambda *xs: xs[int(RNG.integers(len(xs)))]


def loop_match(scores, least):
    g2p, p2g = {}, {}
    for (g, p), s in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
        if s >= least and g not in g2p and p not in p2g:
            g2p[g], p2g[p] = p, g
    return g2p, p2g


def prf(tp, fp, fn):
    if tp + fp + fn == 0:
        return 1.0, 1.0, 1.0
    p, r = (tp / (tp + fp) if tp + fp else 0.0), (tp / (tp + fn) if tp + fn else 0.0)
    return p, r, (2 * p * r / (p + r) if p + r else 0.0)


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def norm(t):
    t = str(t or "").strip()
    if len(t) >= 2 and t[0] in "\"'" and t[0] == t[-1]:
        t = t[1:-1]
    return re.sub(r"\s+", " ", t).strip().lower()


def equal(a, b):
    return a == b or bool(a and b and ((len(a) >= 4 and a in b) or (len(b) >= 4 and b in a)))


def pooled(gold, pred):
    pool, n = list(pred), 0
    for g in gold:
        for i, p in enumerate(pool):
            if equal(g, p):
                pool.pop(i)
                n += 1
                break
    return n


WORDS = ["alpha beta", "Alpha", "'beta'", "gam", "gamma ray", "", "BETA ", "ray"]


def document():
    out = {}
    for side in ("gold", "pred"):
        starts = RNG.integers(0, 300, int(RNG.integers(0, 9)))
        atoms = [(k, pick("x", "y"), int(a), int(a + RNG.integers(1, 60))) for k, a in enumerate(starts)]
        some = lambda: sorted(set(RNG.integers(0, 9, int(RNG.integers(0, 4))).tolist()) & {a[0] for a in atoms})  # noqa: B023, E731
        chunks = [(k, pick("c", "d", None), some()) for k in range(int(RNG.integers(0, 6)))]
        objects = [(k, pick("o", "p"), some(), [pick(*WORDS) for _ in range(int(RNG.integers(0, 4)))]) for k in range(int(RNG.integers(0, 6)))]
        relations = [(k, int(RNG.integers(0, 4)), int(RNG.integers(0, 4)), pick("r", "s")) for k in range(int(RNG.integers(0, 8)))]
        out[side] = (atoms, chunks, objects, relations)
    return out


DOCS = [document() for _ in range(40)]


def frames(spark, which, schema):
    return [spark.createDataFrame([(d, *row) for d, doc in enumerate(DOCS) for row in doc[side][which]], f"doc int, {schema}") for side in ("gold", "pred")]


def strict(g, p, g2p, kind):
    tp = sum(kind(g[a]) == kind(p[b]) for a, b in g2p.items())
    return tp, *prf(tp, len(p) - tp, len(g) - tp), (tp / len(g2p) if g2p else 1.0)


def by_force(doc):
    (ga, gc, go, gr), (pa, pc, po, pr) = doc["gold"], doc["pred"]
    iou = lambda x, y: (min(x[3], y[3]) - max(x[2], y[2])) / (max(x[3], y[3]) - min(x[2], y[2]))
    scores = {(g[0], p[0]): round(iou(g, p), 6) for g in ga for p in pa if iou(g, p) > 0}
    g2p, p2g = loop_match(scores, 0.5)
    out = {"atoms": (*strict(dict(enumerate(ga)), dict(enumerate(pa)), g2p, lambda x: x[1]), round(float(np.mean([scores[m] for m in g2p.items()])), 4) if g2p else 1.0)}
    gset, pset = {c[0]: set(c[2]) for c in gc}, {c[0]: {p2g[a] for a in c[2] if a in p2g} for c in pc}
    c2p, _ = loop_match({(g, p): round(jac(gset[g], pset[p]), 6) for g in gset for p in pset if jac(gset[g], pset[p]) > 0}, 0.5)
    over = sum(bool(pset[p]) and pset[p] < gset[g] for g, p in c2p.items()) + len(pc) - len(c2p)
    out["chunks"] = (*strict(dict(enumerate(gc)), dict(enumerate(pc)), c2p, lambda x: x[1]), over, sum(bool(gset[g]) and gset[g] < pset[p] for g, p in c2p.items()))
    ev = lambda g, p: jac(set(g[2]), {p2g[a] for a in p[2] if a in p2g})

    def pay(g, p):
        a, b = [norm(v) for v in g[3]], [norm(v) for v in p[3]]
        return pooled([x for x in a if x], [x for x in b if x]) / max(len(a), len(b)) if a or b else 1.0

    o2p, p2o = loop_match({(g[0], p[0]): round(0.4 * (g[1] == p[1]) + 0.4 * ev(g, p) + 0.2 * pay(g, p), 6) for g in go for p in po}, 0.4)
    n = [pooled([norm(v) for v in g[3]], [norm(v) for v in po[o2p[g[0]]][3]]) if g[0] in o2p else 0 for g in go]
    ng, np_ = sum(len(g[3]) for g in go), sum(len(po[p][3]) for p in p2o)
    out["objects"] = (*strict(dict(enumerate(go)), dict(enumerate(po)), o2p, lambda x: x[1]), *prf(sum(n), np_ - sum(n), ng - sum(n)), round(sum(ev(go[g], po[p]) for g, p in o2p.items()) / len(go), 4) if go else 1.0)
    ends, used, tp = {}, set(), 0
    for r in pr:
        if r[1] in p2o and r[2] in p2o:
            ends.setdefault((p2o[r[1]], p2o[r[2]]), []).append(r)
    for r in gr:
        left = [x for x in ends.get((r[1], r[2]), []) if x[0] not in used]
        hit = next((x for x in left if x[3] == r[3]), None)
        tp += hit is not None
        used |= {(hit or left[0])[0]} if left else set()
    out["relations"] = (tp, *prf(tp, len(pr) - tp, len(gr) - tp))
    return out


def test_stages(spark):
    ga, pa = frames(spark, 0, "id int, kind string, a int, b int")
    gc, pc = frames(spark, 1, "id int, kind string, atoms array<int>")
    go, po = frames(spark, 2, "id int, kind string, atoms array<int>, values array<string>")
    gr, pr = frames(spark, 3, "id int, source int, target int, kind string")
    atoms = S.match_atoms(ga, pa, 50).cache()
    objects = S.match_objects(go, po, atoms).cache()
    base = ["tp", "precision", "recall", "f1"]
    tables = {
        "atoms": (S.score_atoms(ga, pa, atoms), [*base, "type_accuracy", "mean_iou"]),
        "chunks": (S.score_chunks(gc, pc, S.match_chunks(gc, pc, atoms)), [*base, "type_accuracy", "over_split", "under_split"]),
        "objects": (S.score_objects(go, po, objects), [*base, "type_accuracy", "payload_precision", "payload_recall", "payload_f1", "mean_jaccard"]),
        "relations": (S.score_relations(gr, pr, objects), base),
    }
    for stage, (df, names) in tables.items():
        got = {r.doc: tuple(r[n] for n in names) for r in df.collect()}
        assert len(got) > 25
        for d, row in got.items():
            assert row == pytest.approx(by_force(DOCS[d])[stage], abs=2e-6), (stage, d)
    assert sum(r.tp for r in tables["objects"][0].collect()) > 20


def test_packages_structure_and_suppression(spark):
    objects = spark.createDataFrame([(1, 10, 20), (1, 11, 21)], "doc int, gold_id int, pred_id int")
    keys = spark.createDataFrame([(1, 20, ["a", "b"])], "doc int, pred_id int, keys array<string>")
    packages = spark.createDataFrame([(1, 1, [10, 11, 12], {10: ["a", "z"], 12: ["a"]}), (2, 1, [], {}), (3, 1, [5], None)], "doc int, id int, expected array<int>, fields map<int, array<string>>")
    got = {r.doc: (r.object_recall, r.field_coverage, r.score) for r in S.score_packages(packages, objects, keys).collect()}
    assert got == {1: (0.666667, 0.333333, 0.566667), 2: (1.0, 1.0, 1.0), 3: (0.0, 1.0, 0.3)}
    paths = lambda *p: spark.createDataFrame(list(p), "doc int, path string")
    mentions = lambda *p: spark.createDataFrame(list(p), "doc int, atom int, text string")
    atoms = spark.createDataFrame([(1, 7, 8, 1.0)], "doc int, gold_id int, pred_id int, score double")
    out = S.score_structure(paths((1, "1 > A "), (1, "1"), (2, "x")), paths((1, "1 >  a"), (3, None)), mentions((1, 7, "Rope"), (1, 5, "'cord'")), mentions((1, 8, "rope"), (1, 5, "cord"), (1, 8, "x")), atoms)
    assert {r.doc: (r.sections_f1, r.mentions_f1, r.score) for r in out.collect()} == {1: (0.666667, 0.8, 0.733334), 2: (0.0, 1.0, 0.5), 3: (0.0, 1.0, 0.5)}
    texts = lambda *p: spark.createDataFrame(list(p), "doc int, text string")
    out = S.score_suppression(texts((1, "Figure 3"), (1, "Amp"), (1, ""), (1, None), (1, "gone")), texts((1, "see FIGURE 3"), (1, "op amp")), texts((1, "op amp")))
    assert [tuple(r) for r in out.collect()] == [(1, 5, 1, 0.8)]


def test_matching_in_rounds(spark):
    rows = [(k % 3 or None, int(g), int(p), float(RNG.integers(1, 6))) for k, (g, p) in enumerate(RNG.integers(0, 12, (400, 2)))] + [(0, 1, None, 1.0), (0, 1, 1, None)]
    got = {(r.k, r.gold_id, r.pred_id, r.iou) for r in relational.greedy_matching(spark.createDataFrame(rows, "k int, gold_id int, pred_id int, iou double"), ["k"]).collect()}
    want = set()
    for key in {r[0] for r in rows}:
        best = {}
        for k, g, p, s in rows:
            if k == key and p is not None and s is not None:
                best[g, p] = max(best.get((g, p), 0), s)
        want |= {(key, g, p, best[g, p]) for g, p in loop_match(best, 0)[0].items()}
    assert got == want


def leaves(v):
    if isinstance(v, dict):
        return [x for k in sorted(v) for x in leaves(v[k])]
    return [x for y in v for x in leaves(y)] if isinstance(v, list) else [] if v is None else [str(v)]


def test_payload_leaves(spark):
    docs = [{"b": [1, 2.5, {"x": None, "y": True}], "a": "s", "n": {"z": {"q": "dé"}}}, {}, [], [[[["in"]]], False], "one", 7, None]
    rows = [(k, json.dumps(v)) for k, v in enumerate(docs)] + [(90, None), (91, "no json {"), (92, "")]
    got = {r.id: r["values"] for r in payload.payload_values(spark.createDataFrame(rows, "id int, p string"), ["id"], "p").collect()}
    assert got == {k: leaves(v) for k, v in enumerate(docs)} | {90: [], 91: [], 92: []}
    assert payload.scalar_leaves(spark.createDataFrame([], "id int, p string"), ["id"], "p").count() == 0
