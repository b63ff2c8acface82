"""Coefficient orders against a walk over the diagonals."""

from collections import defaultdict

from tessera.operators import orders


def walk(h, w):
    """(y, x) in order: the corner, then a zig-zag over the square of side w that only stops at rows of the block."""
    step, low = w // h, w // 8
    cells = [(y, x) for y in range(h // 8) for x in range(low)]
    for s in range(2 * w - 1):
        line = [(s - x, x) for x in range(w) if 0 <= s - x < w]
        for far, x in line[::-1] if s % 2 else line:
            if far % step == 0 and not (x < low and far < low):
                cells.append((far // step, x))
    return cells


def test_natural_orders(spark):
    found = defaultdict(dict)
    for r in orders.natural_orders(spark).collect():
        found[r.order_id][r.place] = (r.y, r.x)
    assert sorted(found) == list(range(13))
    for k, (h, w) in enumerate(orders.SHAPES):
        assert [found[k][p] for p in range(len(found[k]))] == walk(h, w)


def test_coded_orders(spark):
    """Channel 1 of order 4 is permuted in part; all else keeps the natural order; coefficients find their places."""
    natural = orders.natural_orders(spark).where("order_id IN (0, 4)")
    swaps = spark.createDataFrame([(4, 1, 2, 5), (4, 1, 5, 2)], "order_id int, channel int, place long, source long")
    coded = orders.coded_orders(natural, swaps)
    values = spark.createDataFrame([(k, c, p) for k in (0, 4) for c in range(3) for p in range(8)], "order_id int, channel int, place long")
    for r in orders.placed(values, coded).collect():
        source = {2: 5, 5: 2}.get(r.place, r.place) if (r.order_id, r.channel) == (4, 1) else r.place
        assert (r.y, r.x) == walk(*orders.SHAPES[r.order_id])[source]
    assert orders.placed(values, coded).count() == 48
    assert orders.placed(values.where("false"), coded).count() == 0
