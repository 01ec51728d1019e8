"""Where words stand on a page: side-by-side tables, phrases, tilt and blocks of lines, and words under marked boxes.

A box is (x0, y0, x1, y1), y downwards. Rows without a page_id are one page. Windows and joins are by page: a page's rows are few;
only boxes can crowd, and those are dealt over a grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold

BOX = ["x0", "y0", "x1", "y1"]


def _met(rows: DataFrame, pages: DataFrame, how: str = "inner") -> DataFrame:
    """rows with their page's columns of pages (page_id, others)."""
    return rows.join(pages.withColumnRenamed("page_id", "_page"), F.col("page_id").eqNullSafe(F.col("_page")), how).drop("_page")


def _middle(values: Column) -> Column:
    """The median of collected values; of an even number the upper one."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def side_by_side(rows: DataFrame, near: float = 6.0, apart: float = 24.0, support: int = 2) -> DataFrame:
    """rows (page_id, row_index, boxes of text and x0..y1, from left to right) with the rows of two tables printed side by side taken apart: the
    left half, then the right half, and row_index counted anew.

    A row of six cells or more speaks for a border in its middle if its halves mirror each other (each cell as far from its half's first one, but
    for `near`) and don't touch there. Borders of a page no more than `apart` from the next one are one border, at their mean. The border with most rows, at
    least `support`, and through no box of the page, divides all rows of six cells or more that lie on both sides of it. A page without such a
    border stays as it is: rows wrongly divided lose more than rows left together. Pages and rows without boxes stay."""
    n = F.size("boxes")
    half = F.floor(n / 2).cast("int")
    left = lambda i: F.get("boxes", i)["x0"]
    mirrored = F.forall(F.sequence(F.lit(0), F.greatest(half - 1, F.lit(0))), lambda i: F.abs(left(i) - left(F.lit(0)) - left(half + i) + left(half)) <= near)
    edges = (F.get("boxes", half - 1)["x1"], left(half))
    # every step is a window of the page, so that rows are dealt by page once and made once
    page = Window.partitionBy("page_id")
    speaks = (n >= 6) & (n % 2 == 0) & mirrored & (edges[1] > edges[0])
    said = rows.select("page_id", "row_index", "boxes", F.when(speaks, (edges[0] + edges[1]) / 2).alias("_at"))
    along = page.orderBy(F.col("_at").asc_nulls_last())
    fresh = F.coalesce(F.col("_at") - F.lag("_at").over(along) > apart, F.lit(True))
    one = said.withColumn("_new", F.col("_at").isNotNull() & fresh).withColumn("_border", F.when(F.col("_at").isNotNull(), F.count_if("_new").over(along.rowsBetween(Window.unboundedPreceding, 0))))
    border = Window.partitionBy("page_id", "_border")
    told = one.withColumns({"_x": F.avg("_at").over(border), "_n": F.count("_at").over(border)})
    # a border is told once, by the row that begins it
    borders = told.withColumn("_borders", F.collect_list(F.when(F.col("_new") & (F.col("_n") >= support), F.struct((-F.col("_n")).alias("n"), F.col("_x").alias("x")))).over(page))
    through = lambda x: F.exists("boxes", lambda b: (b["x0"] < x) & (x < b["x1"]))
    crossed = borders.withColumn("_crossed", F.filter("_borders", lambda b: F.coalesce(through(b["x"]), F.lit(False))))
    crossed = crossed.withColumn("_crossed", F.flatten(F.collect_list(F.when(F.size("_crossed") > 0, F.col("_crossed"))).over(page)))
    best = crossed.select("page_id", "row_index", "boxes", F.array_min(F.array_except("_borders", "_crossed"))["x"].alias("_x"))
    first = F.size(F.filter("boxes", lambda b: b["x0"] <= F.col("_x")))
    two = (n >= 6) & (first > 0) & (first < n)
    parts = F.when(two, F.array(F.slice("boxes", 1, first), F.slice("boxes", first + 1, n - first))).otherwise(F.array("boxes"))
    each = best.select("page_id", F.col("row_index").alias("_row"), F.posexplode(parts).alias("_part", "boxes"))
    order = page.orderBy("_row", "_part")
    return each.select("page_id", (F.row_number().over(order) - 1).alias("row_index"), "boxes")


def cells_of(rows: DataFrame) -> DataFrame:
    """rows with boxes as page_id, row_index, cells and y, the form of page_rows."""
    return rows.select("page_id", "row_index", F.transform("boxes", lambda b: b["text"]).alias("cells"), F.array_min(F.transform("boxes", lambda b: b["y0"])).alias("y"))


#: Signs that a reader of photographs puts before a capitalised word for the edge of a table.
EDGE = r"^[iIl|!\[\]]+(?=\p{Lu}\p{Ll})"


def _spoken(words: DataFrame) -> DataFrame:
    return words.withColumn("text", F.trim(F.regexp_replace(F.trim("text"), EDGE, ""))).where("text <> ''")


def phrases(words: DataFrame, gap: float = 1.2) -> DataFrame:
    """words (page_id, line_id, text, x0..y1) of lines read from a photograph as phrases (page_id, line_id, phrase, text, x0..y1): a gap of `gap`
    times the line's median height ends one (a line without height counts as 20 high). Each has its line's median top and bottom. Words are taken from left to
    right, those at one place by text; words without text go."""
    line = Window.partitionBy("page_id", "line_id")
    middle = lambda c: _middle(F.collect_list(c).over(line))
    tall = middle(F.col("y1") - F.col("y0"))
    rows = _spoken(words).withColumns({"_top": middle(F.col("y0")), "_bottom": middle(F.col("y1")), "_h": F.when(tall == 0, 20.0).otherwise(tall)})
    along = line.orderBy("x0", "x1", "text")
    new = F.coalesce(F.col("x0") - F.lag("x1").over(along) >= gap * F.col("_h"), F.lit(True))
    island = F.count_if("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)) - 1
    rows = rows.withColumn("_new", new).withColumn("phrase", island)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda w: w["text"]), " ")
    return rows.groupBy("page_id", "line_id", "phrase").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("_top").alias("y0"), F.max("x1").alias("x1"), F.min("_bottom").alias("y1"))


def tilt(words: DataFrame) -> DataFrame:
    """page_id and degrees, the tilt of each page's text: the median over its lines of three words or more of the angle of the straight line through
    the words' centres by least squares (downwards to the right is positive). Pages without such a line are left out, as are lines whose words stand
    above each other."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    slopes = words.where(F.trim("text") != "").groupBy("page_id", "line_id").agg(F.regr_slope(y, x).alias("slope"), F.count(F.lit(1)).alias("n"))
    lines = slopes.where("n >= 3 and slope is not null").select("page_id", F.degrees(F.atan("slope")).alias("angle"))
    return lines.groupBy("page_id").agg(_middle(F.collect_list("angle")).alias("degrees"))


def two_blocks(words: DataFrame, rows: DataFrame, widths: DataFrame, least: int = 20) -> DataFrame:
    """Pages (page_id, left, right: the gap) whose text stands in two blocks, as two sheets in one picture do. words: page_id, text, x0..y1; rows: the
    page's printed rows with boxes; widths: page_id, width of the picture. The gap lies in the middle 30 % of the width, is 2 % wide, no word is in it, a
    quarter of the words (of `least` or more) is on each side, and no more than a tenth of the rows goes across, as a table's own rows would. The leftmost such gap is told."""
    inside = _met(words.where(F.trim("text") != "").select("page_id", "x0", "x1"), widths)
    low, high = F.col("width") * 0.35, F.col("width") * 0.65
    clipped = inside.where((F.col("x1") > low) & (F.col("x0") < high)).select("page_id", "width", F.greatest("x0", low).alias("a"), F.least("x1", high).alias("b"))
    ends = inside.select("page_id", "width").distinct().select("page_id", "width", high.alias("a"), high.alias("b"))  # what follows the last word
    along = Window.partitionBy("page_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    gaps = clipped.unionByName(ends).withColumn("left", F.coalesce(F.max("b").over(along), low)).select("page_id", "left", F.col("a").alias("right"), "width")
    gaps = gaps.where((F.col("right") > F.col("left")) & (F.col("right") - F.col("left") >= F.col("width") * 0.02)).select("page_id", "left", "right")
    sides = _met(inside.drop("width"), gaps).groupBy("page_id", "left", "right").agg(F.count_if(F.col("x1") <= F.col("left")).alias("before"), F.count_if(F.col("x0") >= F.col("right")).alias("behind"), F.count(F.lit(1)).alias("n"))
    good = sides.where((F.col("n") >= least) & (F.col("before") >= F.col("n") / 4) & (F.col("behind") >= F.col("n") / 4)).select("page_id", "left", "right")
    across = (F.array_min(F.transform("boxes", lambda b: b["x0"])) < F.col("left")) & (F.array_max(F.transform("boxes", lambda b: b["x1"])) > F.col("right"))
    kept = _met(rows, good).groupBy("page_id", "left", "right").agg(F.count_if(across).alias("across"), F.count(F.lit(1)).alias("n")).where("across <= n * 0.1")
    return kept.groupBy("page_id").agg(F.min(F.struct("left", "right")).alias("_gap")).select("page_id", "_gap.*")


def _grid(boxes: DataFrame, cell: float) -> DataFrame:
    """boxes, each once for each cell of the grid that it lies in."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.greatest(F.floor(F.col(b) / cell), F.floor(F.col(a) / cell)))
    return boxes.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))


def under(words: DataFrame, hits: DataFrame, cell: float = 64.0, crowd: int = 512) -> DataFrame:
    """page_id and word_id of words (page_id, word_id, x0..y1) that overlap a box of hits (page_id, x0..y1); boxes that only touch don't, and neither do
    those without an extent or with a null edge.

    Words and hits meet by page and grid cell, never all of a page's words with all of its hits. The words of a cell that holds more than `crowd` are
    dealt into parts by a hash, and its hits (each distinct box once) go to every part, so no task gets a whole crowd."""
    solid = (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    boxes = _grid(hits.where(solid).select("page_id", *BOX).distinct(), cell)
    marked = boxes.select("page_id", "_cx", "_cy").distinct()
    key = lambda df: df.withColumn("_key", F.struct(F.col("page_id").isNull().alias("none"), F.coalesce("page_id", F.lit(0)).alias("page"), "_cx", "_cy"))
    spread = key(_grid(words.where(solid).select("page_id", "word_id", *BOX), cell)).drop("_cx", "_cy")
    crowds = spread.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).join(key(marked).select("_key"), "_key")
    many = crowds.select("_key", F.ceil(F.col("_n") / crowd).cast("int").alias("_parts"))  # no more than words / crowd rows
    dealt = spread.join(many, "_key", "left").withColumn("_part", F.pmod(F.hash("word_id"), F.coalesce("_parts", F.lit(1))))
    told = key(boxes).join(many, "_key", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    told = told.select("_key", "_part", *(F.col(c).alias(f"_{c}") for c in BOX))
    met = dealt.join(told, ["_key", "_part"]).where((F.col("x0") < F.col("_x1")) & (F.col("_x0") < F.col("x1")) & (F.col("y0") < F.col("_y1")) & (F.col("_y0") < F.col("y1")))
    return met.select("page_id", "word_id").distinct()


def _tokens(text: Column) -> Column:
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def _readable(texts: DataFrame, keys: list[str], needles: DataFrame) -> DataFrame:
    """keys and needle wherever a needle (page_id, needle) can be read in a text (page_id, keys, text): its letters and digits, token by token, whatever
    stands between them. They meet by page and the needle's first token."""
    wanted = needles.select("page_id", "needle", _tokens(F.col("needle")).alias("_wanted")).where(F.size("_wanted") > 0).distinct()
    wanted = wanted.select(F.col("page_id").alias("_page"), "needle", "_wanted", F.get("_wanted", F.lit(0)).alias("_first"))
    said = texts.withColumn("_tokens", _tokens(F.col("text")))
    at = said.select("page_id", *keys, "_tokens", F.posexplode("_tokens").alias("_at", "_token"))
    met = at.join(wanted, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_token") == F.col("_first")))
    return met.where(F.slice("_tokens", F.col("_at") + 1, F.size("_wanted")) == F.col("_wanted")).select("page_id", *keys, "needle").distinct()


def without_boxes(words: DataFrame, hits: DataFrame, needles: DataFrame) -> DataFrame:
    """words (page_id, word_id, text, x0..y1) without those under a box of hits and without those that still spell one of their page's needles. Words without an
    id stay as long as nothing says which of them is meant; hits without a page are hits of the words without a page."""
    gone = under(words, hits).unionByName(_readable(words.select("page_id", "word_id", "text"), ["word_id"], needles).select("page_id", "word_id")).distinct()
    gone = gone.select(F.col("page_id").alias("_page"), F.col("word_id").alias("_word"))
    return words.join(gone, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("word_id") == F.col("_word")), "left_anti")


def surviving(words: DataFrame, needles: DataFrame) -> DataFrame:
    """page_id and needle that can still be read from a page's words in their order (word_id), also across words."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_id", "text"))), lambda w: w["text"]), " ")
    return _readable(words.groupBy("page_id").agg(text.alias("text")), [], needles)
