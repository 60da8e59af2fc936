"""Flow over skylines: against the formulas written out, and how runs are dealt to tasks."""

import numpy as np
from pyspark.sql import functions as F

from skylattice.operators import kernels


def written_out(solid, inlet, steps, relaxation=0.8):
    """The mean along-wind velocity over the second half of the steps, one formula after the other."""
    speeds, weights, opposite = kernels.SPEEDS, kernels.WEIGHTS, [0, 3, 4, 1, 2, 7, 8, 5, 6]

    def equilibrium(rho, u, v):
        along = np.tensordot(speeds[:, 0], u, 0) + np.tensordot(speeds[:, 1], v, 0)
        return weights[:, None, None] * rho * (1 + 3 * along + 4.5 * along**2 - 1.5 * (u * u + v * v))

    u = np.repeat(inlet[:, None], solid.shape[1], axis=1) * ~solid
    f, seen = equilibrium(np.ones_like(u), u, 0 * u), []
    for step in range(steps):
        f = np.stack([np.roll(f[k], (speeds[k, 1], speeds[k, 0]), axis=(0, 1)) for k in range(9)])
        f = np.where(solid, f[opposite], f)
        f[:, :, 0] = equilibrium(np.ones((len(inlet), 1)), inlet[:, None], np.zeros((len(inlet), 1)))[:, :, 0]
        f[:, :, -1] = f[:, :, -2]
        f[:, -1, :] = f[:, -2, :]
        rho = f.sum(axis=0)
        u, v = (np.where(solid, 0, np.tensordot(speeds[:, k], f, (0, 0)) / rho) for k in (0, 1))
        f = np.where(solid, f, f + (equilibrium(rho, u, v) - f) / relaxation)
        if 2 * step >= steps:
            seen.append(u)
    return np.mean(seen, axis=0)


def test_flow_follows_the_formulas():
    solid = np.zeros((14, 26), bool)
    solid[0], solid[:5, 12], solid[:3, 17:19] = True, True, True
    inlet = 0.09 * ((np.arange(14) + 0.5) / 14) ** 0.28
    got, _ = kernels.flow(solid, inlet, 60)
    assert np.abs(got - written_out(solid, inlet, 60)).max() < 1e-13 and got.max() > 0.05


def test_runs_are_dealt_to_many_tasks(spark):
    runs = spark.range(240).select(F.floor(F.col("id") / 4).alias("run"), (F.col("id") % 4).cast("int").alias("k"), (F.col("id") % 3).cast("int").alias("height"))
    found = kernels.flow_runs(runs, steps=4).select("run", "speed", F.spark_partition_id().alias("task")).collect()
    assert len(found) == 240 and len({r["run"] for r in found}) == 60
    assert len({r["task"] for r in found}) > 8
