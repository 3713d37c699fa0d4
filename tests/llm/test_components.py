import random

from brute import Union
from wardstat.llm.components import components


def test_components_of_paths_stars_cycles_and_random_links(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    links += [(rng.randint(300, 420), rng.randint(300, 420)) for _ in range(70)] + [(7, 7), (500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    u = Union({x for ab in links for x in ab})
    for a, b in links:
        u.join(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: u.find(x) for x in linked}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
