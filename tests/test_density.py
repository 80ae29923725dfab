"""Density clusters against all pairs, on crowds, lines of places, single points and the smallest tables."""

import math
import random

import pytest

from roadloom.operators.density import density_clusters

K = math.cos(math.radians(35.0)) * 111320.0


def plain(rows, reach, least):
    xy = {i: (lng * K, lat * 111320.0) for i, lat, lng in rows if lat is not None}
    near = {i: [j for j in xy if (xy[i][0] - xy[j][0]) ** 2 + (xy[i][1] - xy[j][1]) ** 2 <= reach * reach] for i in xy}
    cores = {i for i in xy if len(near[i]) >= least}
    of = {}
    for i in sorted(cores):
        todo = [i] if i not in of else []
        while todo:
            j = todo.pop()
            if j not in of:
                of[j] = i
                todo += [x for x in near[j] if x in cores]
    return sorted((i, of.get(i, min((of[j] for j in near[i] if j in cores), default=None)), i in cores) for i in xy)


def made(seed):
    r = random.Random(seed)
    rows = [(35 + r.gauss(0, 0.0002), 129 + r.gauss(0, 0.0002)) for _ in range(150)] + [(35.003, 129.0)] * 40 + [(35 + r.uniform(-0.01, 0.01), 129 + r.uniform(-0.01, 0.01)) for _ in range(120)]
    rows += [(35.02 + i * 0.0004, 129.0 + r.uniform(0, 0.0001)) for i in range(30) for _ in range(2)] + [(None, 1.0)]
    r.shuffle(rows)
    return [(i * 3, *x) for i, x in enumerate(rows)]


@pytest.mark.parametrize(("seed", "reach", "least"), [(1, 60.0, 4), (2, 30.0, 10), (3, 45.0, 1), (4, 200.0, 3)])
def test_against_all_pairs(spark, seed, reach, least):
    rows = made(seed)
    df = spark.createDataFrame(rows, "point_id long, lat double, lng double")
    assert sorted(map(tuple, density_clusters(df, reach, least, 35.0).collect())) == plain(rows, reach, least)


def test_empty(spark):
    assert density_clusters(spark.createDataFrame([], "point_id long, lat double, lng double"), 50.0, 3).isEmpty()
