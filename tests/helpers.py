"""Dense numpy statements of what the operators compute, and fixture builders."""

import numpy as np


def unit(m):
    m = np.asarray(m, dtype=float)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def catalog(spark, vectors, names=None, sequences=None):
    names = names or [f"p{i}" for i in range(len(vectors))]
    rows = [
        (i, n, [float(v) for v in vec], None if sequences is None else sequences[i])
        for i, (n, vec) in enumerate(zip(names, vectors))
    ]
    df = spark.createDataFrame(
        rows, "ord long, protein_id string, embedding array<double>, sequence string"
    )
    return df if sequences is not None else df.drop("sequence")


def long_counts(spark, matrix, samples=None, proteins=None):
    matrix = np.asarray(matrix, dtype=float)
    samples = samples or [f"s{i}" for i in range(matrix.shape[0])]
    proteins = proteins or [f"p{i}" for i in range(matrix.shape[1])]
    rows = [
        (s, p, float(matrix[a, b]))
        for a, s in enumerate(samples)
        for b, p in enumerate(proteins)
    ]
    return spark.createDataFrame(
        rows, "sample_id string, protein_id string, value double"
    )


def square(df, value="distance"):
    table = df.toPandas()
    names = sorted(set(table["sample_a"]) | set(table["sample_b"]))
    out = np.zeros((len(names), len(names)))
    for r in table.itertuples():
        a, b = names.index(r.sample_a), names.index(r.sample_b)
        out[a, b] = out[b, a] = getattr(r, value)
    return out


def dense_mmd(counts, z, sigma=None, weighted=True):
    counts = np.asarray(counts, dtype=float)
    counts = counts if weighted else np.sign(counts)
    keep = counts.sum(axis=0) > 0
    p = counts[:, keep]
    p = p / p.sum(axis=1, keepdims=True)
    z = unit(np.asarray(z)[keep])
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    if sigma is None:
        sigma = np.median(d[np.triu_indices(len(z), 1)])
    g = p @ np.exp(-0.5 * (d / sigma) ** 2) @ p.T
    own = np.diag(g)
    return np.sqrt(np.maximum(own[:, None] + own[None] - 2 * g, 0)), sigma


def components_of(adjacent):
    label = np.arange(len(adjacent))
    for _ in range(len(adjacent)):
        low = np.array(
            [min(label[np.flatnonzero(row)].min(initial=l), l) for row, l in zip(adjacent, label)]
        )
        if np.array_equal(low, label):
            break
        label = low
    return label


def dense_mcl(weights, inflation):
    """Cluster name per node: the smallest member.

    Expands and inflates to a fixed point of the rounded matrix. Its attractors are the nodes
    with return mass; attractors that share mass are one system, and a node belongs to the
    system that most of its column's mass is in.
    """
    flow = np.array(weights, dtype=float)
    np.fill_diagonal(flow, 0)
    loops = flow.max(axis=0)
    np.fill_diagonal(flow, np.where(loops > 0, loops, 1))
    flow /= flow.sum(axis=0)
    while True:
        grown = np.linalg.matrix_power(flow, 2) ** inflation
        grown /= grown.sum(axis=0)
        if np.array_equal(grown.round(12), flow.round(12)):
            break
        flow = grown
    attractors = np.flatnonzero(np.diag(flow) > 1e-6)
    shared = flow[np.ix_(attractors, attractors)] > 1e-6
    system = components_of((shared | shared.T).astype(float))
    mass = np.zeros((len(attractors), len(flow)))
    np.add.at(mass, system, flow[attractors])
    owner = mass.argmax(axis=0)
    return np.array([np.flatnonzero(owner == k).min() for k in owner])


def edges_of(spark, s):
    i, j = np.nonzero(np.triu(s, 1))
    rows = [(int(a), int(b), float(s[a, b])) for a, b in zip(i, j)]
    return spark.createDataFrame(rows, "i long, j long, weight double")
