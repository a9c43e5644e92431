"""Interleaves sources by target weights with Pfair scheduling, in DataFrame functions only.

Each source's rows form blocks. Weights are whole numbers, and as long as all sources last a source of weight
w among weights that sum up to A is due w / A of the slots. A source that runs out leaves its slots to the
others, whose ratios stay. Served in tiny equal parts, block j of the source would thus be worked on between the
times t(j) and t(j + 1), where t grows by A / w per block and A falls as sources run out. The block's release is
floor(t(j)) and its deadline ceil(t(j + 1)), in whole numbers without rounding. Earliest-deadline-first over
released blocks (ties by source) fills every slot and meets every deadline, so at any slot a source is less than
one block away from its exact share. No row is dropped or repeated; there is one rule for every size.

The schedule is made in frames of slots, all at once. A frame is at least as long as the longest time between a
release and its deadline, and begins one frame early from a guess of what is done by then: all that is due, and of
the blocks begun those with the nearest deadlines. Two runs that differ in what they have done differ only until
those blocks are due, so after the early frame the run is the one that began at slot 0.

Null is a source of its own. Repeated rows are rows like any other. Sources should number some thousands at most
(they stand in one array), their rows any number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldstate.llm.numbering import digest_of, key_text, number_rows
from worldstate.llm.rows import ID, rejoin, with_row_id
from worldstate.session import cut_lineage

BLOCK_ROWS = 4
TEMPERATURE = 0.5
WEIGHT_SCALE = 1000
LEAST_FRAME = 1024
CHUNK_BLOCKS = 4096
CHUNK_SLOTS = 128


def source_weights(
    docs: DataFrame, source: str, parts: dict[str | None, int] | None = None, block_rows: int = BLOCK_ROWS, temperature: float = TEMPERATURE
) -> DataFrame:
    """``__key, weight, blocks`` per source.

    Without ``parts`` the weight is the source's rows to the power ``temperature``, in thousandths, 1 at least.
    Sources that ``parts`` doesn't name get 1.
    """
    sizes = docs.groupBy(key_text(F.col(source)).alias("__key")).agg(F.count(F.lit(1)).alias("n"))
    if parts is None:
        weight = F.greatest(F.lit(1), F.floor(WEIGHT_SCALE * F.pow(F.col("n"), F.lit(temperature)) + 0.5))
    else:
        if any(c < 1 for c in parts.values()):
            raise ValueError("parts are 1 at least")
        weight = F.lit(1)
        for name, c in parts.items():
            weight = F.when(F.col("__key") == key_text(F.lit(name)), F.lit(c)).otherwise(weight)
    return sizes.select("__key", weight.cast("long").alias("weight"), F.ceil(F.col("n") / block_rows).cast("long").alias("blocks"))


def _whole(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def _fields(**columns: Column) -> Column:
    return F.named_struct(*[c for name, column in columns.items() for c in (F.lit(name), column)])


def _divided(a: Column, b: Column) -> Column:
    """Whole part of a quotient of numbers of up to 38 digits."""
    return F.call_function("div", a, b)


def windows(weights: DataFrame) -> DataFrame:
    """``__key, block, release, deadline`` of every block."""
    everyone = weights.groupBy().agg(F.collect_list(F.struct("__key", "weight", "blocks")).alias("s")).filter("size(s) > 0")

    def later(a: Column, b: Column) -> Column:
        """Which of two sources runs out first? By blocks / weight, then key."""
        first, second = _whole(a["blocks"]) * _whole(b["weight"]), _whole(b["blocks"]) * _whole(a["weight"])
        return F.when(first < second, -1).when(first > second, 1).when(a["__key"] < b["__key"], -1).when(a["__key"] > b["__key"], 1).otherwise(0)

    def total(of: Column, field: str) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda n, x: n + x[field])

    everyone = everyone.select(F.array_sort("s", later).alias("s"))

    def phase(p: Column) -> Column:
        """After p sources have run out: when the last of them did, the weight that is left, the blocks that are gone."""
        last = F.get("s", p - 1)
        gone, left = F.slice("s", F.lit(1), p), F.slice("s", p + 1, F.size("s"))
        return _fields(over=last["blocks"], by=last["weight"], weight=total(left, "weight"), gone=total(gone, "blocks"))

    own = everyone.select(F.transform(F.sequence(F.lit(0), F.size("s") - 1), phase).alias("phases"), F.explode("s").alias("x"))

    def begun(p: Column) -> Column:
        """The source's first block edge in the phase."""
        over, by = _whole(p["over"]) * _whole(F.col("x.weight")), _whole(p["by"])
        edge = F.coalesce(_divided(over + by - 1, by), F.lit(0).cast("long"))
        return _fields(edge=edge, weight=p["weight"], gone=p["gone"])

    own = own.select("x.*", F.filter(F.transform("phases", begun), lambda p: p["edge"] <= F.col("x.blocks")).alias("phases"))
    chunks = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / CHUNK_BLOCKS))).alias("chunk"))
    low = F.col("chunk") * CHUNK_BLOCKS
    high = F.least(F.col("blocks"), low + CHUNK_BLOCKS)
    before = F.filter("phases", lambda p: p["edge"] <= low)
    inside = F.filter("phases", lambda p: (p["edge"] > low) & (p["edge"] <= high))
    chunks = chunks.select("__key", "weight", F.concat(F.slice(before, F.lit(-1), F.lit(1)), inside).alias("phases"), low.alias("low"), high.alias("high"))
    blocks = chunks.repartition("__key", "low").select("__key", "weight", "phases", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("block"))

    def time(edge: Column, up: bool) -> Column:
        p = F.element_at(F.filter("phases", lambda p: p["edge"] <= edge), -1)
        product = _whole(p["weight"]) * _whole(edge)
        return p["gone"] + _divided(product + (F.col("weight") - 1 if up else F.lit(0)).cast("decimal(19,0)"), _whole(F.col("weight")))

    return blocks.select("__key", "block", time(F.col("block"), False).alias("release"), time(F.col("block") + 1, True).alias("deadline"))


def _earliest_deadline_first(own: Column, done: Column, start: Column, end: Column) -> Column:
    """``done, order``: blocks done of each source after the slots from ``start`` to before ``end``, and the block of each slot.

    ``own`` has per source its blocks' windows in order; ``done`` says how many of them are over.
    """
    nothing = F.array().cast("array<struct<i:int,n:int>>")

    def state(done: Column, order: Column) -> Column:
        return _fields(done=done, order=order)

    def step(held: Column, slot: Column) -> Column:
        def next_of(x: Column, i: Column) -> Column:
            n = F.get(held["done"], i)
            window = F.get(x["windows"], n)
            return F.when(window["release"] <= slot, _fields(due=window["deadline"], i=i, n=n))

        chosen = F.array_min(F.transform(own, next_of))

        def taken(c: Column) -> Column:
            after = F.transform(held["done"], lambda n, i: n + F.when(i == c["i"], 1).otherwise(0))
            return state(after, F.concat(held["order"], F.array(_fields(i=c["i"], n=c["n"]))))

        return F.transform(F.array(chosen), taken)[0]  # found once per slot, not once per source

    def part(held: Column, first: Column) -> Column:
        """Some slots with a list of their own, so that long lists are copied seldom."""
        slots = F.sequence(first, F.least(first + CHUNK_SLOTS, end) - 1)
        return F.transform(F.array(F.aggregate(slots, state(held["done"], nothing), step)), lambda p: state(p["done"], F.concat(held["order"], p["order"])))[0]

    firsts = F.when(start < end, F.sequence(start, end - 1, F.lit(CHUNK_SLOTS).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(firsts, state(done, nothing), part)


def schedule(weights: DataFrame, least_frame: int = LEAST_FRAME) -> DataFrame:
    """``__key, block, slot, release, deadline`` of every block."""
    slots, heavy, light = weights.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.sum("weight"), F.min("weight")).first()
    blocks = cut_lineage(windows(weights), "windows")
    frame = max(least_frame, heavy // light + 3) if slots else 1  # no window is longer
    frames = -(-slots // frame)
    # all that is due at a frame's early start
    due = blocks.groupBy(F.ceil(F.col("deadline") / frame).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    due = due.select((F.col("at") + 1).alias("frame"), F.sum("n").over(upto).alias("over"))
    seen = F.sequence(F.floor(F.col("release") / frame), F.least(F.lit(frames - 1), F.ceil(F.col("deadline") / frame)))
    held = blocks.select("*", F.explode(seen).alias("frame"))
    held = held.groupBy("frame", "__key").agg(F.array_sort(F.collect_list(F.struct("block", "release", "deadline"))).alias("windows"))
    held = held.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("__key", "windows"))).alias("own"))
    held = held.join(due, "frame", "left").repartition(max(1, min(frames, 8 * weights.sparkSession.sparkContext.defaultParallelism)), "frame")
    early, start = F.greatest(F.lit(0).cast("long"), (F.col("frame") - 1) * frame), F.col("frame") * frame
    end = F.least(F.lit(slots), start + frame)
    held = held.select("own", early.alias("early"), start.alias("start"), end.alias("end"), F.coalesce("over", F.lit(0)).alias("over"))

    def begun(x: Column, i: Column) -> Column:
        first = x["windows"][0]
        return F.when(first["release"] < F.col("early"), _fields(due=first["deadline"], i=i))

    waiting = F.array_sort(F.filter(F.transform("own", begun), lambda x: x.isNotNull()))
    held = held.withColumn("ahead", F.transform(F.slice(waiting, F.lit(1), (F.col("early") - F.col("over")).cast("int")), lambda x: x["i"]))
    held = held.withColumn("done", F.transform("own", lambda x, i: F.array_contains("ahead", i).cast("int")))
    held = held.withColumn("done", _earliest_deadline_first(F.col("own"), F.col("done"), F.col("early"), F.col("start"))["done"])
    held = held.withColumn("order", _earliest_deadline_first(F.col("own"), F.col("done"), F.col("start"), F.col("end"))["order"])

    def placed(o: Column, at: Column) -> Column:
        x = F.get("own", o["i"])
        window = F.get(x["windows"], o["n"])
        return _fields(__key=x["__key"], block=window["block"], slot=F.col("start") + at, release=window["release"], deadline=window["deadline"])

    return held.select(F.explode(F.transform("order", placed)).alias("b")).select("b.*")


def mix(
    docs: DataFrame, source: str = "source", order: str = "doc_id", parts: dict[str | None, int] | None = None,
    block_rows: int = BLOCK_ROWS, temperature: float = TEMPERATURE, ties: tuple[Column, ...] = (), least_frame: int = LEAST_FRAME,
) -> DataFrame:
    """Adds ``block`` (number within the source), ``slot`` (place of the block in the mix),
    ``release``, ``deadline`` (slot lies in [release, deadline)) and ``place`` (row within the block).

    A source's rows are taken in the order of a digest of ``order``. Columns of these names are replaced.
    """
    weights = cut_lineage(source_weights(docs, source, parts, block_rows, temperature), "weights")
    plan = cut_lineage(schedule(weights, least_frame), "schedule")
    rows = docs.drop("block", "slot", "release", "deadline", "place")
    found = number_rows(rows, key_text(F.col(source)), digest_of(F.col(order)), "__n", (F.col(order), *ties))
    block, place = F.floor(F.col("__n") / block_rows), (F.col("__n") % block_rows).cast("int")
    found = found.withColumns({"block": block, "place": place, "__key": key_text(F.col(source))}).drop("__n")
    outputs = [F.col(f"`{c}`") for c in rows.columns] + [F.col(c) for c in ("block", "place", "slot", "release", "deadline")]
    return found.join(plan, ["__key", "block"]).select(*outputs)


def in_order(mixed: DataFrame, files: int, slots: int, slot: str = "slot", place: str = "place") -> DataFrame:
    """The rows in ``files`` partitions, so that written files follow one another in the mix's order."""
    part = F.least(F.lit(files - 1), F.floor(F.col(slot) * files / max(slots, 1))).cast("int")
    return mixed.repartitionById(files, part).sortWithinPartitions(slot, place)


def arranged(docs: DataFrame, rows_per_file: int, source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """All rows, laid out partition after partition in the order of the mix.

    Only source and key are numbered and scheduled; whole rows move twice, to their places and to their files.
    """
    names = with_row_id(docs).select(F.col(source).alias("__source"), F.col(key).alias("__order"), *ID)
    mixed = cut_lineage(mix(names, "__source", "__order", ties=tuple(map(F.col, ID)), **how).select(*ID, "slot", "place"), "mixed")
    total, slots = mixed.agg(F.count(F.lit(1)), F.coalesce(F.max("slot"), F.lit(0))).first()
    files = max(1, -(-total // rows_per_file), docs.sparkSession.sparkContext.defaultParallelism)
    wanted = mixed.join(mixed.groupBy(*ID).agg(F.count(F.lit(1)).alias("__rows")), list(ID))
    wanted = wanted.select(*ID, "__rows", F.col("slot").alias("__slot"), F.col("place").alias("__place"))
    found = rejoin(docs, wanted)
    return in_order(found, files, slots + 1, "__slot", "__place").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_report(docs: DataFrame) -> DataFrame:
    mixed = mix(docs.select("doc_id", "source"))
    whole = ("block", "slot", "release", "deadline")
    return mixed.select("doc_id", "source", *[F.col(c).cast("long").alias(c) for c in whole], "place")


MIX_SQL = f"""
with recursive sizes as (select source, count(*) as n from documents group by source),
parts as (
  select source, row_number() over (order by coalesce('=' || source, '')) - 1 as i, cast(ceil(n / {BLOCK_ROWS}.0e0) as bigint) as b,
    cast(greatest(1, floor({WEIGHT_SCALE} * pow(n, {TEMPERATURE}) + 0.5e0)) as hugeint) as w
  from sizes),
edges as (
  select i, w, unnest(range(0, b + 1)) as j from parts),
times as (
  select e.i, e.j, e.w,
    cast(sum(case when p.b * e.w <= p.w * e.j then p.b else 0 end) as hugeint) as gone,
    cast(sum(case when p.b * e.w <= p.w * e.j then 0 else p.w end) as hugeint) as active
  from edges e, parts p group by e.i, e.j, e.w),
ends as (
  select i, j, cast(gone + (active * j) // w as bigint) as low, cast(gone + (active * j + w - 1) // w as bigint) as high from times),
windows as (
  select a.i, a.j, a.low as r, z.high as d from ends a join ends z on z.i = a.i and z.j = a.j + 1),
listed as (
  select list(rs order by i) as rs, list(ds order by i) as ds, cast(sum(len(rs)) as bigint) as slots
  from (select i, list(r order by j) as rs, list(d order by j) as ds from windows group by i) q),
edf as (
  select cast(-1 as bigint) as slot, cast(null as bigint) as i, cast(null as bigint) as j, list_transform(rs, lambda x: cast(0 as bigint)) as done,
    list_min(list_transform(range(0, len(rs)), lambda x: case when rs[x + 1][1] <= 0 then ds[x + 1][1] * 1000000 + x end)) % 1000000 as pick
  from listed
  union all
  select slot, i, j, done, list_min(list_transform(range(0, len(l.rs)), lambda x:
    case when done[x + 1] < len(l.rs[x + 1]) and l.rs[x + 1][done[x + 1] + 1] <= slot + 1
      then l.ds[x + 1][done[x + 1] + 1] * 1000000 + x end)) % 1000000 as pick
  from (
    select slot + 1 as slot, pick as i, done[pick + 1] as j,
      list_transform(range(0, len(done)), lambda x: done[x + 1] + case when x = pick then 1 else 0 end) as done
    from edf where pick is not null) q, listed l),
numbered as (
  select doc_id, source, row_number() over (partition by source order by md5(cast(doc_id as varchar)), doc_id) - 1 as n from documents)
select d.doc_id, d.source, d.n // {BLOCK_ROWS} as block, e.slot, w.r as "release", w.d as deadline, cast(d.n % {BLOCK_ROWS} as int) as place
from numbered d join parts p on p.source is not distinct from d.source
join edf e on e.i = p.i and e.j = d.n // {BLOCK_ROWS} and e.slot >= 0
join windows w on w.i = p.i and w.j = d.n // {BLOCK_ROWS}
"""
