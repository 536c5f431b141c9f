import numpy as np
import pytest

from wattloom.operators import blockwise, clustering, density, mixture

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (12, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "id long, a double, b double").cache()


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster"], set()).add(r["id"] // 12)
    return out


def test_search_finds_the_blobs(blobs):
    for score in ("si", "db", "ch"):
        labelled, value, k = clustering.search(blobs, COLUMNS, score, repeats=1, max_k=4)
        assert k == 3 and all(len(g) == 1 for g in groups(labelled).values())
    with pytest.raises(ValueError):
        clustering.search(blobs.limit(1), COLUMNS)


def test_scores(blobs):
    labelled = clustering.kmeans(blobs, COLUMNS, 3)
    x = np.array([(r["a"], r["b"]) for r in labelled.collect()])
    c = np.array([r["cluster"] for r in labelled.collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        means = {k: d[i][(c == k) & (np.arange(len(x)) != i)].mean() for k in set(c)}
        a, b = means[c[i]], min(v for k, v in means.items() if k != c[i])
        s.append((b - a) / max(a, b))
    assert clustering.silhouette_score(labelled, COLUMNS).first()["mean_silhouette"] == pytest.approx(np.mean(s))


def test_ward_and_dbscan_find_the_blobs(blobs):
    assert sorted(map(len, groups(clustering.ward(blobs, COLUMNS, 3)).values())) == [1, 1, 1]
    found = groups(clustering.dbscan(blobs, COLUMNS, 0.5, 3))
    assert sorted(k for k in found if k is not None) == [0, 12, 24] and all(len(found[k]) == 1 for k in (0, 12, 24))


def plain_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        def cost(pair):
            a, b = (x[groups[j]] for j in pair)
            return len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()

        i, j = min(((i, j) for j in range(len(groups)) for i in range(j)), key=cost)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("block", [20, 2000])
def test_ward_equals_a_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(clustering, "WARD_BLOCK", block)
    x = np.random.default_rng(4).normal(size=(40, 2))
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "id long, a double, b double")
    for k in (4,):
        found = {}
        for r in clustering.ward(rows, COLUMNS, k).collect():
            found.setdefault(r["cluster"], set()).add(r["id"])
        assert set(map(frozenset, found.values())) == plain_ward(x, k)


def test_density_search_leaves_noise_out(spark, blobs):
    rows = blobs.unionByName(spark.createDataFrame([(100, 50.0, 50.0)], "id long, a double, b double"))
    labelled, score, (eps, least) = clustering.density_search(rows, COLUMNS, (0.01, 0.5), (3,))
    assert (eps, least) == (0.5, 3) and score > 0.9 and labelled.where("cluster is null").count() == 1
    assert clustering.silhouettes(labelled, COLUMNS).count() == 36
    assert clustering.density_search(rows, COLUMNS, (1000.0,), (2,)) == (None, -1.0, None)


def test_two_stage_with_wards_criterion(blobs):
    labelled, mapping = clustering.two_stage(blobs, COLUMNS, COLUMNS, 2, repeats=1, max_k=3, clusterer=clustering.ward)
    assert labelled.count() == 36 and len(mapping) == 3


def test_parts_are_searched_in_common_rounds(spark, blobs, monkeypatch):
    calls, real = [], clustering.all_kmeans
    monkeypatch.setattr(clustering, "all_kmeans", lambda *a, **k: calls.append(1) or real(*a, **k))
    labelled, mapping = clustering.two_stage(blobs, ["a"], ["b", "a"], 1, repeats=2, max_k=3, score="ch")
    assert labelled.count() == 36 and len(mapping) > 1 and len(calls) == 2  # one for each stage
    parts = [blobs.where("id < 24"), blobs.where("id >= 12")]
    together = clustering.search_parts(parts, [24, 24], COLUMNS, "ch", 2, max_k=3)
    for part, (_, score, k) in zip(parts, together, strict=True):
        alone = clustering.search(part, COLUMNS, "ch", 2, max_k=3)
        assert (score, k) == (pytest.approx(alone[1]), alone[2])


def test_silhouettes_of_clusters_that_few_blocks_have(spark, monkeypatch):
    from wattloom.operators import blockwise

    x = np.random.default_rng(5).normal(size=(40, 2))
    points = as_rows(spark, x).selectExpr("id", "a", "b", "1 + id % 2 as weight")
    labels = spark.createDataFrame([(m, k, c) for k in range(40) for m, c in ((0, k // 3), (1, k % 2), (2 + k // 20, k % 4)) if (k + m) % 7], "labelling int, id long, cluster long")
    found = []
    for rows in (1000, 5):
        monkeypatch.setattr(blockwise, "ROWS", rows)
        found.append({(r["labelling"], r["id"]): (r["cluster"], r["silhouette"]) for r in blockwise.all_silhouettes(points, COLUMNS, labels).collect()})
    assert found[0].keys() == found[1].keys() and len(found[0]) == labels.count()
    assert all(found[1][k] == (c, pytest.approx(s)) for k, (c, s) in found[0].items())


def test_equally_near_centres_go_to_the_first():
    x = np.array([[0.5, 1.0 / 3], [7.0, 0.1]])
    assert clustering.nearest_centres(x, np.array([[[0.1, 0.3]] * 3, [[1.0, 2.0], [0.0, 0.3], [0.0, 0.3]]])).tolist() == [[0, 0], [1, 0]]


def test_two_stage_labels_follow_ids(blobs):
    labelled, mapping = clustering.two_stage(blobs, ["a"], ["b", "a"], 1, repeats=1, max_k=3)
    assert labelled.count() == 36 and sorted(c for cs in mapping.values() for c in cs) == list(range(sum(map(len, mapping.values()))))


def test_mixture(blobs):
    labelled, score, k = mixture.gaussian_mixture(blobs, COLUMNS, range(2, 4))
    assert labelled.count() == 36 and k in (2, 3)


def plain_forest(x, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, m - 1] if m <= len(x) else np.full(len(x), np.inf)
    return d, core


def plain_dbscan(x, eps, m):
    """The smallest core reached; None for noise."""
    d, core = plain_forest(x, m)
    cores = [i for i in range(len(x)) if core[i] <= eps]
    label = {}
    for i in cores:
        if i in label:
            continue
        todo, label[i] = [i], i
        while todo:
            a = todo.pop()
            for b in cores:
                if b not in label and d[a, b] <= eps:
                    label[b] = i
                    todo.append(b)
    return [label.get(i, min((label[j] for j in cores if d[i, j] <= eps), default=None)) for i in range(len(x))]


@pytest.fixture(scope="module")
def lumps():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.05, 25), ((1, 0), 0.1, 20), ((0.4, 0.8), 0.2, 25))])
    x[5:15] = x[5]  # equal rows
    return np.round(x, 3)


def as_rows(spark, x):
    return spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "id long, a double, b double")


def test_of_many_points_only_near_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr("wattloom.operators.blockwise.ROWS", 12)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.1, (60, 2)) for c in ((0, 0), (4, 0), (0, 6))] + [rng.uniform(-9, 9, (12, 2))])
    rows, met = as_rows(spark, x), []
    plain = density.Forest(rows, COLUMNS, (2, 5))
    monkeypatch.setattr(density, "MANY", 20)
    real = density.against_all
    monkeypatch.setattr(density, "against_all", lambda blocks, *a, pairs=None, **k: met.append((blocks.count() ** 2, pairs and pairs.count())) or real(blocks, *a, pairs=pairs, **k))
    forest = density.Forest(rows, COLUMNS, (2, 5))
    assert min(n / every for every, n in met[1:3]) < 0.4  # the nearest points, and the trees of pairs
    near = [{r["id"]: [(e["id"], e["d"], e["w"]) for e in r["near"]] for r in f.near.collect()} for f in (plain, forest)]
    assert near[0] == near[1]
    for m in (2, 5):
        trees = [sorted(r["reach"] for r in f.trees.where(f"m = {m}").collect()) for f in (plain, forest)]
        assert len(trees[1]) == len(x) - 1 and trees[1] == pytest.approx(trees[0])  # all minimum trees have the same edges' lengths
    labels = [sorted(map(tuple, f.labellings((0.05, 0.2, 1.0, 3.0)).collect())) for f in (plain, forest)]
    assert labels[0] == labels[1]


@pytest.mark.parametrize("block", [1000, 16])
def test_one_forest_gives_every_dbscan(spark, monkeypatch, lumps, block):
    monkeypatch.setattr("wattloom.operators.blockwise.ROWS", block)
    forest = density.Forest(as_rows(spark, lumps), COLUMNS, (2, 4, 11))
    points = {r["id"]: tuple(r[c] for c in COLUMNS) for r in forest.points.collect()}
    assert sum(r["weight"] for r in forest.points.collect()) == 70 and len(points) < 70
    found = {}
    for r in forest.labellings((0.02, 0.05, 0.1, 0.3, 2.0)).collect():
        found[r["m"], r["eps"], points[r["id"]]] = r["cluster"]
    for m in (2, 4, 11):
        for eps in (0.02, 0.05, 0.1, 0.3, 2.0):
            want = plain_dbscan(lumps, eps, m)
            assert [found.get((m, eps, tuple(v))) for v in lumps.tolist()] == want, (m, eps)


def test_the_order_of_optics(spark, monkeypatch, lumps):
    monkeypatch.setattr("wattloom.operators.blockwise.ROWS", 16)
    forest = density.Forest(as_rows(spark, lumps), COLUMNS, (4,))
    got = sorted(forest.orders().collect(), key=lambda r: r["place"])
    d, core = plain_forest(lumps, 4)
    reach = np.maximum(np.maximum(d, core[:, None]), core)
    ids = [r["id"] for r in got]
    assert ids[0] == 0 and len(set(ids)) == len(ids)
    for k in range(1, len(ids)):  # each is the nearest of those that are left
        left = [i for i in ids[k:]]
        nearest = reach[np.ix_(ids[:k], left)].min(0)
        assert got[k]["reach"] == pytest.approx(nearest.min()) and nearest[left.index(ids[k])] == pytest.approx(nearest.min())


def test_clusters_of_a_reachability_plot():
    inf = float("inf")
    plot = np.array([inf, 0.1, 0.1, 0.1, 0.11, 1.0, 0.2, 0.2, 0.2, 0.21, 2.0, 0.3, 0.3, 0.3])
    found = density.steep_clusters(plot, 0.3, 3)
    assert {(0, 4), (5, 9), (10, 13)} <= set(found)
    label = density.innermost(found, len(plot))
    assert label.tolist() == [label[0]] * 5 + [label[5]] * 5 + [label[10]] * 4 and len(set(label.tolist())) == 3
    assert density.steep_clusters(np.full(9, 1.0), 0.3, 3) == [] or (density.innermost(density.steep_clusters(np.full(9, 1.0), 0.3, 3), 9) <= 0).all()


def test_optics_finds_the_blobs(spark, blobs):
    found = groups(clustering.optics(blobs, COLUMNS, 0.5, 4))
    assert len([k for k in found if k is not None]) == 3 and all(len(v) == 1 for k, v in found.items() if k is not None)
    labelled, score, (_, least) = clustering.optics_search(blobs, COLUMNS, (0.05, 0.5), (3, 4), noise=True)
    assert score > 0.5 and labelled.count() == 36


def test_fits_together_equal_fits_one_by_one(spark, lumps):
    rows = as_rows(spark, lumps)
    first = [lumps[:3].astype(float), lumps[[0, 30, 60, 69]].astype(float), lumps[5:8].astype(float)]
    fits = clustering.all_kmeans(rows, COLUMNS, first)
    for begin, centres, sizes, within in zip(first, fits.centres, fits.sizes, fits.within, strict=True):
        c = begin.copy()
        for _ in range(100):
            own = ((lumps[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.array([lumps[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))])
        assert np.allclose(np.sort(centres, 0), np.sort(c, 0)) and sorted(sizes) == sorted(np.bincount(own, minlength=len(c)))
        assert within.sum() == pytest.approx(((lumps - c[own]) ** 2).sum())
    for score in ("si", "db", "ch"):
        got = clustering.fit_scores(rows, COLUMNS, fits, score, (1.0, 0.0))
        for c, value in zip(fits.centres[:2], got, strict=False):
            want = clustering.SCORES[score](clustering.assign(rows, COLUMNS, c.tolist()), COLUMNS, (1.0, 0.0))
            assert value == pytest.approx(want)


def test_ward_merges_equal_and_tied_rows_in_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(clustering, "WARD_BLOCK", 8)
    rounds = []
    real = clustering.nearest_clusters
    monkeypatch.setattr(clustering, "nearest_clusters", lambda *a: rounds.append(1) or real(*a))
    same = spark.createDataFrame([(k, 1.0, 2.0) for k in range(500)] + [(900, 5.0, 5.0)], "id long, a double, b double")
    assert sorted(r["count"] for r in clustering.ward(same, COLUMNS, 2).groupBy("cluster").count().collect()) == [1, 500] and not rounds
    grid = spark.createDataFrame([(k, float(k % 8), float(k // 8)) for k in range(64)], "id long, a double, b double")  # neighbours equally far apart
    assert clustering.ward(grid, COLUMNS, 3).count() == 64 and len(rounds) <= 12


def test_ward_over_many_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(clustering, "WARD_BLOCK", 20)
    monkeypatch.setattr(clustering, "WARD_LEAF", 4, raising=False)
    monkeypatch.setattr(blockwise, "ROWS", 10)
    x = np.random.default_rng(5).normal(size=(50, 2)) * np.linspace(0.2, 3, 50)[:, None]
    tables = []
    real = clustering.nearest_clusters
    monkeypatch.setattr(clustering, "nearest_clusters", lambda c, *a: tables.append(len(c.inputFiles())) or real(c, *a))
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "id long, a double, b double")
    found = {}
    for r in clustering.ward(rows, COLUMNS, 6).collect():
        found.setdefault(r["cluster"], set()).add(r["id"])
    assert set(map(frozenset, found.values())) == plain_ward(x, 6)
    assert len(tables) > 2 and min(tables) > 0  # a round starts from a table: no plan that grows with the rounds


def plain_em(x, parts, family, rounds):
    for _ in range(rounds):
        logs = parts.logs(x)
        r = np.exp(logs - mixture.log_sum(logs)[:, None])
        n = r.sum(0)
        mu = (r.T @ x) / n[:, None]
        cov = np.stack([((x - m).T * w) @ (x - m) / w.sum() for m, w in zip(mu, r.T, strict=True)])
        if family == "tied":
            cov = np.broadcast_to((cov * n[:, None, None]).sum(0) / n.sum(), cov.shape)
        elif family == "diag":
            cov = cov * np.eye(x.shape[1])
        elif family == "spherical":
            cov = (np.trace(cov, axis1=1, axis2=2) / x.shape[1])[:, None, None] * np.eye(x.shape[1])
        parts = mixture.Parts(n / n.sum(), mu, cov + mixture.FLOOR * np.eye(x.shape[1]))
    return parts


def test_families_and_folds_together_equal_plain_em(spark, lumps, monkeypatch):
    monkeypatch.setattr(mixture, "ROUNDS", 6)
    monkeypatch.setattr(mixture, "TOLERANCE", -1.0)
    rng = np.random.default_rng(1)
    x = lumps + rng.normal(size=lumps.shape) * 0.02
    fold = np.arange(70) % 3
    points = spark.createDataFrame([(k, v.tolist(), int(f)) for k, (v, f) in enumerate(zip(x, fold, strict=True))], "id long, x array<double>, fold int")
    begin = x[[0, 30, 60]]
    fits = [mixture.Fit(f, 3, fold) for f in mixture.FAMILIES for fold in (0, 2, -1)]
    got = mixture.fit_all(points, 2, fits, {f: {3: begin} for f in (0, 2, -1)})
    for f, parts in zip(fits, got, strict=True):
        part = x[fold != f.fold]
        own = np.eye(3)[((part[:, None] - begin) ** 2).sum(2).argmin(1)]
        want = mixture.shaped(f.family, own.sum(0), own.T @ part, np.einsum("nk,ni,nj->kij", own, part, part), None)
        want = plain_em(part, want, f.family, 6)
        assert np.allclose(parts.means, want.means) and np.allclose(parts.covariances, want.covariances) and np.allclose(parts.shares, want.shares)


def test_a_mixture_labels_new_rows(spark, blobs):
    model = mixture.fit_mixture(blobs, COLUMNS, (2, 3), ("tied", "spherical"), 3)
    assert len(model.parts.shares) == 3
    new = spark.createDataFrame([(1, 0.0, 0.1), (2, 5.1, 0.0), (3, 0.1, 5.0), (4, None, 1.0), (5, 0.05, 0.0)], "id long, a double, b double")
    got = {r["id"]: r["cluster"] for r in model.predict(new).collect()}
    assert got[1] == got[5] and len({got[1], got[2], got[3]}) == 3 and got[4] is None


def test_silhouettes_of_parts_let_only_their_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(blockwise, "ROWS", 10)
    rng = np.random.default_rng(8)
    points = spark.createDataFrame([(k, k % 3, 1, float(a), float(b)) for k, (a, b) in enumerate(rng.normal(size=(90, 2)))], "id long, fold int, weight int, a double, b double")
    labels = spark.createDataFrame([(3 * l + k % 3, k, int(c)) for l in range(2) for k, c in enumerate(rng.integers(0, 3, 90))], "labelling int, id long, cluster long")
    met, real = [], blockwise.against_all
    monkeypatch.setattr(blockwise, "against_all", lambda *a, pairs=None, **k: met.append(pairs) or real(*a, pairs=pairs, **k))
    whole = {(r["labelling"], r["id"]): r["silhouette"] for r in blockwise.all_silhouettes(points, COLUMNS, labels).collect()}
    parts = {(r["labelling"], r["id"]): r["silhouette"] for r in blockwise.all_silhouettes(points, COLUMNS, labels, "fold").collect()}
    assert len(whole) == 180 and parts == pytest.approx(whole)
    assert met[1].count() <= 27  # three parts of at most three blocks each, instead of 81 pairs


def test_scores_of_fits_make_no_row_for_a_point_and_a_labelling(spark, lumps, monkeypatch):
    monkeypatch.setattr(blockwise, "ROWS", 12)
    monkeypatch.setattr(clustering, "SCORED", 9)  # several passes
    monkeypatch.setattr(clustering, "COLUMNS", 3)
    sent, real = [], clustering.against_all
    monkeypatch.setattr(clustering, "against_all", lambda blocks, *a, **k: sent.append([f.name for f in blocks.schema["rows"].dataType.elementType]) or real(blocks, *a, **k))
    rows = as_rows(spark, lumps)
    first = [lumps[at].astype(float) for at in ([0, 30, 60], [0, 30, 60, 69], [1, 2], [20, 40, 50, 55, 65])]
    fits = clustering.all_kmeans(rows, COLUMNS, first, rounds=5)
    got = clustering.fit_scores(rows, COLUMNS, fits, "si", (0.7, 0.3))
    want = [clustering.SCORES["si"](clustering.assign(rows, COLUMNS, c.tolist()), COLUMNS, (0.7, 0.3)) for c in fits.centres]
    assert got == pytest.approx(want) and sent and all(s == ["id", "x"] for s in sent)
    some = clustering.fit_scores(rows, COLUMNS, fits, "si", (0.7, 0.3), best=True)
    assert some[int(np.argmax(want))] == pytest.approx(max(want)) and None in some
    assert all(v is None or v == pytest.approx(w) for v, w in zip(some, want, strict=True))


def test_rounds_of_few_tasks_need_no_shuffle(spark, lumps, monkeypatch):
    rows, first = as_rows(spark, lumps).repartition(3), [lumps[:3].astype(float), lumps[[0, 30, 60, 69]].astype(float)]
    base, grouped, real = type(rows), [], type(rows).groupBy
    monkeypatch.setattr(base, "groupBy", lambda df, *a: grouped.append(a) or real(df, *a))
    fits = [clustering.all_kmeans(rows, COLUMNS, first)]
    assert not grouped
    monkeypatch.setattr(clustering, "FEW_TASKS", 0)
    fits.append(clustering.all_kmeans(rows, COLUMNS, first))
    assert grouped
    for a, b in zip(*fits, strict=True):
        assert all(np.allclose(x, y) for x, y in zip(a, b, strict=True))


def test_labellings_of_many_clusters_are_scored_in_bounded_passes(spark, monkeypatch):
    monkeypatch.setattr(blockwise, "ROWS", 9)
    monkeypatch.setattr(density, "CLUSTERS", 30)
    monkeypatch.setattr(density, "MEETING", 4)
    monkeypatch.setattr(density, "COLUMNS", 7)
    rng = np.random.default_rng(6)
    points = as_rows(spark, rng.normal(size=(60, 2))).selectExpr("id", "a", "b", "1 + id % 2 as weight")
    made = [(l, k, int(c)) for l, n in enumerate((2, 25, 40, 3)) for k, c in enumerate(rng.integers(0, n, 60)) if (k + l) % 5]
    labels = spark.createDataFrame([(l, k, 0 if l == 3 and c else c) for l, k, c in made], "labelling int, id long, cluster long")
    widths, real = [], density.pass_scores
    monkeypatch.setattr(density, "pass_scores", lambda p, c, ls, n, some, least: widths.append([k for _, k in some]) or real(p, c, ls, n, some, least))
    got = {}
    for r in density.block_scores(points, COLUMNS, labels).collect():
        got.setdefault(r["labelling"], []).append((r["n"], r["s"], r["q"]))
    want = {}
    for r in blockwise.all_silhouettes(points, COLUMNS, labels).collect():
        want.setdefault(r["labelling"], []).append((r["weight"], r["silhouette"]))
    assert len(widths) > 1 and all(len(w) == 1 or sum(w) <= 30 for w in widths) and got.keys() == want.keys()
    for l, parts in got.items():
        n, s, q = np.array(parts).T
        w, v = np.array(want[l]).T
        assert n.sum() == w.sum() and s.sum() == pytest.approx((w * v).sum())
        assert (q + n * (s / n - s.sum() / n.sum()) ** 2).sum() == pytest.approx((w * (v - (w * v).sum() / w.sum()) ** 2).sum())


def test_boxes_of_blocks_meet_without_a_task_for_each_pair_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(blockwise, "ROWS", 10)
    x = np.random.default_rng(3).uniform(size=(200, 2))
    blocks = blockwise.near_blocked(as_rows(spark, x), COLUMNS)
    boxes = {r["b"]: (np.array(r["lo"]), np.array(r["hi"])) for r in blocks.collect()}
    gap = lambda i, j: np.linalg.norm(np.maximum(np.maximum(boxes[i][0] - boxes[j][1], boxes[j][0] - boxes[i][1]), 0))
    far = blocks.join(blocks.select("b"), "b").checkpoint()  # as where a block's reach is joined to it; its size is not known
    pairs = blockwise.near_pairs(far, "0.1D")
    assert "CartesianProduct" not in pairs._jdf.queryExecution().executedPlan().toString()
    near = {(i, j) for i in boxes for j in boxes if gap(i, j) <= 0.1}
    assert {tuple(r) for r in pairs.collect()} == near
    half = [tuple(r) for r in blockwise.near_pairs(far, "0.1D", half=True).collect()]
    assert len(half) == len(set(half)) and {tuple(sorted(p)) for p in half} == {tuple(sorted(p)) for p in near} and len(half) == (len(near) + len(boxes)) // 2
    assert max(sum(to == i for to, _ in half) for i in boxes) < max(sum(p == i for p, _ in near) for i in boxes)
