"""Squeeze schedules: which channels are halved along which axis in which order, for all images at once.

Tables:

* channels: image, position, height, width, hshift, vshift of the channels before any step; images may have their own numbers and sizes
* steps: image, step (from 0), begin, n, in_place, horizontal: channels at positions begin to begin + n - 1 are halved; what each
  lacks becomes a channel of its own, behind the last of them (in_place) or behind all
* links: image, step, id, residual, horizontal: a step of one channel.  Ids stay with a channel: its position before any step,
  and numbers from there on for the new ones

A channel's samples are rows (image, id, y, x, v).  Images of WHOLE samples at most take one shuffle for all steps: they come one
after the other to a task, which holds about HELD samples and treats images of one shape and schedule side by side.  Larger images
go by rounds.  Every round applies one step of each of these in one pass over strips of lines; channels that have no part in it go through untouched.  Inverse rounds start with the last step of each image, and a
channel's samples join them when the first step that needs them does, so what is shuffled grows as the image does.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

STRIP = 64
SMALL = 8  #: the default schedule ends with sides of so many samples at most
DEEPEST = 30
WHOLE, HELD = 1 << 19, 1 << 18


def default_steps(channels: DataFrame, meta: int = 0) -> DataFrame:
    """The steps that images without a list of their own have: second and third channel first, if they are as large as the
    first, then all channels along their longer side, and on along both, until both sides are SMALL at most."""
    own = channels.where(F.col("position") >= meta)
    at = lambda k, c: F.max(F.when(F.col("position") == meta + k, F.col(c)))
    size = own.groupBy("image").agg(F.count(F.lit(1)).cast("int").alias("n"), *(at(k, c).alias(f"{c[0]}{k}") for k in (0, 1) for c in ("height", "width")))
    halvings = lambda c: F.greatest(F.lit(0), F.ceil(F.log2(F.ceil(F.col(c) / SMALL).cast("double"))).cast("int"))
    upright = ((F.col("h0") >= F.col("w0")) & (F.col("h0") > SMALL)).cast("int")
    row = lambda order, begin, n, in_place, horizontal: F.struct(order.cast("int").alias("order"), begin.cast("int").alias("begin"), n.cast("int").alias("n"), F.lit(in_place).alias("in_place"), F.lit(horizontal).alias("horizontal"))
    first, empty = F.lit(meta), "array<struct<order:int,begin:int,n:int,in_place:boolean,horizontal:boolean>>"
    chroma = F.when((F.col("n") >= 3) & (F.col("h0") == F.col("h1")) & (F.col("w0") == F.col("w1")), F.array(*(row(F.lit(k - 3), first + 1, F.lit(2), False, not k) for k in (0, 1)))).otherwise(F.array().cast(empty))

    def along(c: str, horizontal: bool, order) -> Column:
        many = halvings(c)
        made = F.transform(F.sequence(F.lit(0), F.greatest(many, F.lit(1)) - 1), lambda j: row(order(j), first, F.col("n"), True, horizontal))
        return F.when(many > 0, made).otherwise(F.array().cast(empty))

    listed = F.concat(chroma, along("w0", True, lambda j: 2 * j), along("h0", False, lambda j: 2 * (j - upright) + 1))
    steps = size.select("image", F.explode(listed).alias("s")).select("image", "s.*")
    return steps.withColumn("step", F.row_number().over(Window.partitionBy("image").orderBy("order")) - 1).drop("order")


ERRORS = ("range", "empty", "deep")
LAYOUT = "kind string, step int, id int, residual int, horizontal boolean, position int, height long, width long, hshift int, vshift int, error string"


def layout(channels: DataFrame, steps: DataFrame, meta: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, places, errors).  places: image, position, id, height, width, hshift, vshift of the channels after all steps.  errors:
    image, step, error of images with a step that is none; they have no links and places.

    An image's channels and steps are a few numbers; each image's list is made in one group."""
    rows = channels.select("image", F.lit(0).alias("part"), F.col("position").cast("int").alias("a"), F.lit(0).alias("n"), F.lit(False).alias("in_place"), F.lit(False).alias("horizontal"), F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"), F.col("hshift").cast("int").alias("hshift"), F.col("vshift").cast("int").alias("vshift"), F.lit(-1).alias("step"))
    rows = rows.unionByName(steps.select("image", F.lit(1).alias("part"), F.col("begin").cast("int").alias("a"), F.col("n").cast("int").alias("n"), "in_place", "horizontal", *(F.lit(0).cast(t).alias(c) for c, t in (("height", "long"), ("width", "long"), ("hshift", "int"), ("vshift", "int"))), F.col("step").cast("int").alias("step")))
    fields = T.StructType.fromDDL(LAYOUT)
    schema = T.StructType([channels.schema["image"], *fields])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = table.to_pylist()
        out, error = stepped(sorted((r for r in own if not r["part"]), key=lambda r: r["a"]), sorted((r for r in own if r["part"]), key=lambda r: r["step"]), meta)
        out = [{"kind": "error", "step": error[0], "error": error[1]}] if error else out
        arrow = pa.schema([table.schema.field("image"), *((f.name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in fields)])
        return pa.Table.from_pylist([{"image": key[0].as_py()} | r for r in out], arrow)

    found = rows.groupBy("image").applyInArrow(run, schema)
    of = lambda kind, *columns: found.where(F.col("kind") == kind).select("image", *columns)
    return of("link", "step", "id", "residual", "horizontal"), of("place", "position", "id", "height", "width", "hshift", "vshift"), of("error", "step", "error")


def stepped(channels: list[dict], steps: list[dict], meta: int) -> tuple[list[dict], tuple | None]:
    """Links and places of one image, and the first step that is none with what is wrong."""
    row = [{"id": k, **{c: r[c] for c in ("height", "width", "hshift", "vshift")}} for k, r in enumerate(channels)]
    links, fresh = [], len(row)
    for s in steps:
        begin, end = s["a"], s["a"] + s["n"]
        if begin < 0 or s["n"] < 0 or end > len(row) or begin < meta and (not s["in_place"] or end > meta):
            return [], (s["step"], "range")
        meta += s["n"] if begin < meta else 0
        side, shift = ("width", "hshift") if s["horizontal"] else ("height", "vshift")
        new = []
        for c in row[begin:end]:
            if not c["height"] or not c["width"]:
                return [], (s["step"], "empty")
            if max(c["hshift"], c["vshift"]) > DEEPEST:
                return [], (s["step"], "deep")
            deeper = c[shift] + (c[shift] >= 0)
            new.append(c | {"id": fresh, side: c[side] // 2, shift: deeper})
            links.append({"kind": "link", "step": s["step"], "id": c["id"], "residual": fresh, "horizontal": s["horizontal"]})
            c[side], c[shift] = -(-c[side] // 2), deeper
            fresh += 1
        row = row[:end] + new + row[end:] if s["in_place"] else row + new
    return [*links, *({"kind": "place", "position": k, **c} for k, c in enumerate(row))], None


# ---- lines ----


def slope(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Tendency by the two differences of three averages in a row."""
    least = np.minimum(np.minimum((4 * np.abs(p) + 3 * np.abs(q) + 6) // 12, 2 * np.abs(p) + 1), 2 * np.abs(q))
    return np.where((p >= 0) & (q >= 0), least, np.where((p <= 0) & (q <= 0), -least, 0))


def half(gap: np.ndarray) -> np.ndarray:
    return np.where(gap < 0, -(-gap // 2), gap // 2)


def paired(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Averages and residuals of lines; the lines are columns."""
    first, second = v[::2], v[1::2]
    average = first.copy()
    gap = first[: len(second)] - second
    average[: len(second)] -= half(gap)
    before = np.concatenate([average[:1], second])[: len(second)]
    after = np.concatenate([average[1:], average[-1:]])[: len(second)]
    own = average[: len(second)]
    return average, gap - slope(before - own, own - after)


def unpaired(average: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Lines of averages and residuals; each second sample feeds the next pair's tendency, and lines advance side by side."""
    out = np.zeros((len(average) + len(residual), average.shape[1]), np.int64)
    out[2 * len(residual) :] = average[len(residual) :]
    before = average[0] if len(average) else None
    for k, rest in enumerate(residual):
        now, ahead = average[k], average[min(k + 1, len(average) - 1)]
        gap = rest + slope(before - now, now - ahead)
        out[2 * k] = now + half(gap)
        out[2 * k + 1] = before = out[2 * k] - gap
    return out


# ---- all steps of an image at once ----


def _along(v: np.ndarray, flat: bool) -> np.ndarray:
    """Images (k, y, x) as lines: the axis that is halved comes first."""
    return np.moveaxis(v, 2 if flat else 1, 0)


def _stepped(channels: dict[int, np.ndarray], links: np.ndarray, back: bool) -> None:
    """All steps on images of one shape and schedule, in place; links: step, id, residual, horizontal."""
    links = links[np.argsort(links[:, 0], kind="stable")]
    for _, own, other, flat in (links[::-1] if back else links).tolist():
        if own not in channels:
            continue
        first = _along(channels[own], flat)
        sides = first.shape[1:]
        lines = first.reshape(len(first), -1)
        if back:
            rest = channels.pop(other, None)
            made = [unpaired(lines, np.zeros((0, lines.shape[1]), np.int64) if rest is None else _along(rest, flat).reshape(-1, lines.shape[1]))]
        else:
            made = paired(lines)
        for channel, v in zip((own, other), made):
            channels[channel] = np.moveaxis(v.reshape(-1, *sides), 0, 2 if flat else 1)


def _images(table: pa.Table, back: bool):
    """A batch for each shape and schedule.  table: image, kind, a, b, c, d, by image: links (kind 0: step, id, residual, horizontal)
    and samples (kind 1: id, y, x, v)."""
    coded = table.column("image").combine_chunks().dictionary_encode("encode")
    code, (kind, *rest) = coded.indices.to_numpy(), (table.column(c).to_numpy() for c in ("kind", "a", "b", "c", "d"))
    rest = np.stack(rest, 1).astype(np.int64)
    links, linked = rest[kind == 0], code[kind == 0]
    order = np.lexsort((links[:, 1], links[:, 0], linked))
    links, linked = links[order], linked[order]
    cells, of = rest[kind == 1], code[kind == 1]
    order = np.lexsort((cells[:, 0], of))
    cells, of = cells[order], of[order]
    if not len(cells):
        return
    start = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (cells[1:, 0] != cells[:-1, 0])]))
    stop = np.append(start[1:], len(cells))
    sides = np.maximum.reduceat(cells[:, 1:3], start) + 1
    edge = np.searchsorted(linked, np.arange(len(coded.dictionary) + 1))
    first = np.searchsorted(of[start], np.arange(len(coded.dictionary) + 1))
    alike = {}
    for k in range(len(coded.dictionary)):
        a, b = first[k], first[k + 1]
        if a < b:
            alike.setdefault((cells[start[a:b], 0].tobytes(), sides[a:b].tobytes(), links[edge[k] : edge[k + 1]].tobytes()), []).append(k)
    for own in alike.values():
        own, channels, out = np.array(own), {}, []
        for j in range(first[own[0] + 1] - first[own[0]]):
            at = first[own] + j
            size = stop[at] - start[at]
            rows = np.repeat(start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
            v = np.zeros((len(own), *sides[at[0]]), np.int64)
            v[np.repeat(np.arange(len(own)), size), cells[rows, 1], cells[rows, 2]] = cells[rows, 3]
            channels[int(cells[start[at[0]], 0])] = v
        _stepped(channels, links[edge[own[0]] : edge[own[0] + 1]], back)
        for channel, v in channels.items():
            k, y, x = (i.reshape(-1) for i in np.indices(v.shape))
            out.append((own[k], np.full(len(k), channel, np.int32), y, x, v.reshape(-1)))
        k, *columns = map(np.concatenate, zip(*out))
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(k)), *map(pa.array, columns)], ["image", "id", "y", "x", "v"])


def _whole(samples: DataFrame, links: DataFrame, back: bool) -> DataFrame:
    """All steps of all images, each image in one task."""

    def run(batches):
        held, count, most = [], 0, HELD
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < most:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            code = table.column("image").combine_chunks().dictionary_encode("encode").indices.to_numpy()
            cut = int(np.searchsorted(code, code[-1]))  # rows come by image, so codes ascend; the last image may go on
            if cut:
                yield from _images(table.slice(0, cut), back)
            held, count = table.slice(cut).to_batches(), len(table) - cut
            most = max(HELD, 2 * count)
        if held:
            yield from _images(pa.Table.from_batches(held), back)

    number = lambda *columns: [F.col(c).cast("long").alias(n) for c, n in zip(columns, "abcd")]
    rows = links.select("image", F.lit(0).alias("kind"), *number("step", "id", "residual", "horizontal"))
    rows = rows.unionByName(samples.select("image", F.lit(1).alias("kind"), *number("id", "y", "x", "v")))
    kind = dict(samples.dtypes)["image"]
    return rows.repartition("image").sortWithinPartitions("image").mapInArrow(run, f"image {kind}, id int, y long, x long, v long")


def _split(samples: DataFrame, links: DataFrame, sizes: DataFrame | None, back: bool, rounds) -> DataFrame:
    """Images of WHOLE samples at most at once, others by rounds.  sizes: image, n (samples), counted if not given."""
    sizes = samples.groupBy("image").agg(F.count(F.lit(1)).alias("n")) if sizes is None else sizes
    large = sizes.where(F.col("n") > WHOLE).select("image")
    if large.isEmpty():
        return _whole(samples, links, back)
    small = (t.join(large, "image", "left_anti") for t in (samples, links))
    return _whole(*small, back).unionByName(rounds(*(t.join(large, "image", "left_semi") for t in (samples, links))))


# ---- rounds over large images ----


def _round(samples: DataFrame, parts: DataFrame, back: bool) -> DataFrame:
    """One step of each image.  parts: image, part_id, target, other, part (0: averages, 1: residuals), flat (horizontal)."""
    held = samples.join(parts, (samples["image"] == parts["image_"]) & (samples["id"] == parts["part_id"]), "left").drop("image_", "part_id")
    turned = F.coalesce(~F.col("flat"), F.lit(False))
    lines = held.select(
        "image", F.coalesce("target", "id").alias("id"), "other", F.coalesce("part", F.lit(0)).alias("part"), turned.alias("turned"),
        F.when(turned, F.col("x")).otherwise(F.col("y")).alias("line"), F.when(turned, F.col("y")).otherwise(F.col("x")).alias("at"), "v",
    ).withColumn("strip_", F.floor(F.col("line") / STRIP))

    def grid(table: pa.Table, part: int, low: int, lines_: int) -> np.ndarray:
        own = table.filter(pa.compute.equal(table.column("part"), part))
        at = own.column("at").to_numpy()
        out = np.zeros((int(at.max(initial=-1)) + 1, lines_), np.int64)
        out[at, own.column("line").to_numpy() - low] = own.column("v").to_numpy()
        return out

    def run(key: tuple, table: pa.Table) -> pa.Table:
        other, turned = table.column("other")[0].as_py(), table.column("turned")[0].as_py()
        low = pa.compute.min(table.column("line")).as_py()
        count = pa.compute.max(table.column("line")).as_py() - low + 1
        first = grid(table, 0, low, count)
        if other is None:
            made = [(key[1].as_py(), first)]
        elif back:
            made = [(key[1].as_py(), unpaired(first, grid(table, 1, low, count)))]
        else:
            average, residual = paired(first)
            made = [(key[1].as_py(), average), (other, residual)]
        out = []
        for own, values in made:
            at, line = (i.reshape(-1) for i in np.indices(values.shape))
            y, x = (at, line + low) if turned else (line + low, at)
            out.append(pa.table([pa.repeat(key[0], len(at)), pa.repeat(pa.scalar(own, pa.int32()), len(at)), pa.array(y), pa.array(x), pa.array(values.reshape(-1))], ["image", "id", "y", "x", "v"]))
        return pa.concat_tables(out)

    kind = dict(samples.dtypes)["image"]
    return lines.groupBy("image", "id", "strip_").applyInArrow(run, f"image {kind}, id int, y long, x long, v long")


def _parts(links: DataFrame, rank: int, back: bool) -> DataFrame:
    """The part of each channel in the round of that rank."""
    now = links.where(F.col("rank") == rank)
    own = now.select(F.col("image").alias("image_"), F.col("id").alias("part_id"), F.col("id").alias("target"), F.col("residual").alias("other"), F.lit(0).alias("part"), F.col("horizontal").alias("flat"))
    rest = now.select(F.col("image").alias("image_"), F.col("residual").alias("part_id"), F.col("id").alias("target"), F.col("residual").alias("other"), F.lit(1).alias("part"), F.col("horizontal").alias("flat"))
    return own.unionByName(rest) if back else own


def _typed(samples: DataFrame) -> DataFrame:
    return samples.select("image", F.col("id").cast("int").alias("id"), *(F.col(c).cast("long").alias(c) for c in "yxv"))


def squeezed(samples: DataFrame, links: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """All steps of all images: samples (image, id, y, x, v) with ids of the first channels to those of all.
    sizes: image, n (its samples in all channels), where they are known already."""
    return _split(samples, links, sizes, False, _squeezed_by_rounds)


def unsqueezed(samples: DataFrame, links: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The inverse: samples of all channels to those of the first ones.  Squeezing leaves sizes (image, n) as they are."""
    return _split(samples, links, sizes, True, _unsqueezed_by_rounds)


def _squeezed_by_rounds(samples: DataFrame, links: DataFrame) -> DataFrame:
    ranked = links.withColumn("rank", F.col("step"))
    rounds = ranked.agg(F.max("rank")).first()[0]  # one number
    out = _typed(samples)
    for rank in range(-1 if rounds is None else rounds + 1):
        out = _round(out, _parts(ranked, rank, False), False)
    return out


def _unsqueezed_by_rounds(samples: DataFrame, links: DataFrame) -> DataFrame:
    last = Window.partitionBy("image")
    ranked = links.withColumn("rank", F.max("step").over(last) - F.col("step"))
    rounds = ranked.agg(F.max("rank")).first()[0]  # one number
    if rounds is None:
        return _typed(samples)
    enters = ranked.select(F.col("image").alias("image_"), F.explode(F.array("id", "residual")).alias("part_id"), "rank").groupBy("image_", "part_id").agg(F.min("rank").alias("enters"))
    waiting = _typed(samples).join(enters, (F.col("image") == F.col("image_")) & (F.col("id") == F.col("part_id")), "left").drop("image_", "part_id")
    out = None
    for rank in range(rounds + 1):
        new = waiting.where(F.coalesce("enters", F.lit(rounds)) == rank).drop("enters")
        out = _round(new if out is None else out.unionByName(new), _parts(ranked, rank, True), True)
    return out
