"""Intake: duplicates, classification by name or title block, time budget, regions to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs as X, fixed
from ..plans import skew


def opt(df: DataFrame, name: str, default, kind: str):
    """A column, or a typed constant when the table does not have it."""
    return F.col(name) if name in df.columns else F.lit(default).cast(kind)


def same_content(pictures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pictures, written, and one row per content of a job: its lowest id and how many pictures have it."""
    kept = skew.settle(pictures.drop("dup_of"))
    return kept, kept.groupBy("job_id", "hash").agg(F.min("id").alias("__first"), F.count(F.lit(1)).alias("__n"))


def mark_copies(kept: DataFrame, groups: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Pictures with what ``same_content`` found: the others of a content become 'unused' and point to its lowest id."""
    df = skew.lookup(kept, groups.filter("__n > 1"), ["job_id", "hash"], size="__n", hot_rows=hot_rows)
    later = F.col("id") > F.col("__first")
    return df.withColumns({"role": F.when(later, F.lit("unused")).otherwise(F.col("role")),
                           "dup_of": F.when(later, F.col("__first"))}).drop("__first")


def dedup_first(pictures: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Same content within a job: the lowest id stays, the others become 'unused' and point to it."""
    return mark_copies(*same_content(pictures), hot_rows)


def without_copies(kept: DataFrame, groups: DataFrame, hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """The rows of ``mark_copies`` that are no copies. Most copies are left out before any row moves: a picture that is not the first of its content is one,
    unless a part of its key is missing."""
    firsts = groups.select("job_id", F.col("__first").alias("id"))
    few = skew.sieve(kept, firsts, ["job_id", "id"], F.col("hash").isNull(), hot_rows)
    return mark_copies(few, groups, hot_rows).filter("dup_of IS NULL")


def classify_by_name(pictures: DataFrame, name: str = "name") -> DataFrame:
    """Role, case number and letter told by the file name; first matching rule wins."""
    text = F.lower(X.stem(name))
    role = F.coalesce(*[F.when(text.rlike(rx), F.lit(r)) for r, rx in fixed.NAME_ROLES])
    role = F.when(role.isin(*fixed.MAIN_ROLES) & X.view_hint(name).isNotNull(), F.concat(F.lit("x_"), role)).otherwise(role)
    number = F.regexp_extract(text, fixed.NAME_CASE, 1).try_cast("long")
    return (pictures.withColumn("role", role).withColumn("case_no", number)
            .withColumn("letter", F.when((F.col("case_no") > 0) & F.col("role").isin(*fixed.CASE_ROLES),
                                         F.char((F.lit(64) + F.col("case_no")).cast("int"))))
            .withColumn("confidence", F.when(F.col("role").isNull(), F.lit("low")).otherwise(F.lit("medium")))
            .withColumn("role", F.coalesce("role", F.lit("unknown"))))


def _matched(text, pattern, group):
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _units_across_lines(lines: DataFrame, key: str) -> DataFrame:
    """Unit whose label ends one line and whose value begins a later one, below the seventh line."""
    tail = lines.filter(F.col("line_no") >= 7)
    opened = tail.filter(F.col("text").rlike(r"Unit\s*([:;]\s*)?$"))
    after = tail.select(key, (F.col("line_no") - 1).alias("line_no"), F.col("text").alias("t1"))
    after2 = tail.select(key, (F.col("line_no") - 2).alias("line_no"), F.col("text").alias("t2"))
    joined = opened.join(after, [key, "line_no"], "left").join(after2, [key, "line_no"], "left")
    unit = _matched(F.concat_ws(" ", F.regexp_extract("text", r"(Unit\s*([:;]\s*)?)$", 1), "t1", "t2"), fixed.HEAD_UNIT, 1)
    return joined.select(key, "line_no", unit.alias("unit")).filter("unit IS NOT NULL")


def classify_by_header(lines: DataFrame, key: str = "image_id") -> DataFrame:
    """Title block (lines numbered from 1) -> letter, model, unit, role, result kind; one row per picture.

    Everything comes out of one aggregation that Spark combines before the shuffle; only the few first lines are kept.
    """
    no, text = F.col("line_no"), F.col("text")
    head = F.when((no <= 3) & text.rlike(fixed.HEAD_LETTER),
                  F.struct(no, F.regexp_extract(text, fixed.HEAD_LETTER, 1).alias("letter"),
                           F.regexp_replace(F.trim(F.regexp_extract(text, fixed.HEAD_LETTER, 2)), fixed.HEAD_JUNK, "").alias("model")))
    kind = F.when((no <= 7) & text.rlike(fixed.HEAD_TYPE), F.struct(no, F.trim(F.regexp_extract(text, fixed.HEAD_TYPE, 1)).alias("t")))
    unit = F.when((no > 7) & text.rlike(fixed.HEAD_UNIT), F.struct(no, F.regexp_extract(text, fixed.HEAD_UNIT, 1).alias("u")))
    first = [F.max(F.when(no == i, text)).alias(f"l{i}") for i in range(1, 8)]
    df = lines.groupBy(key).agg(F.min(head).alias("h"), F.min(kind).alias("k"), F.min(unit).alias("late"), *first)
    spread = _units_across_lines(lines, key).groupBy(key).agg(F.min(F.struct("line_no", F.col("unit").alias("u"))).alias("spread"))
    df = df.join(spread, key, "left")
    top = F.concat_ws(" ", *[f"l{i}" for i in range(1, 8)])
    type_text = F.coalesce(F.col("k.t"), F.lit(""))
    name_line = F.coalesce(F.col("l2"), F.lit(""))
    source = F.lower(F.concat(type_text, F.lit(" | "), name_line))
    early = _matched(top, fixed.HEAD_UNIT, 1)
    late = F.when(F.col("spread.line_no") < F.col("late.line_no"), F.col("spread.u")).otherwise(F.coalesce("late.u", "spread.u"))
    df = df.select(key, F.col("h.letter").alias("letter"), F.col("h.model").alias("model"), F.coalesce(early, late).alias("unit"),
                   F.col("h").isNotNull().alias("has_header"), type_text.alias("type_text"), name_line.alias("name_line"),
                   source.alias("source"), F.lower(F.concat_ws(" ", "l1", "l2", "l3")).alias("first_three"))
    df = df.withColumn("is_result", (F.col("type_text") != "") | F.col("unit").isNotNull())
    static = F.col("first_three").rlike(fixed.HEAD_STATIC)
    other = F.col("is_result") | (F.col("source").rlike(fixed.HEAD_OTHER) & ~static)
    role = (F.when(F.col("source").contains("total deformation"), F.lit("deformation"))
            .when(F.col("source").rlike(fixed.HEAD_STRESS), F.lit("stress"))
            .when(other, F.lit("x_other")).when(static, F.lit("bc")))
    shown = X.clean_kind(F.when(F.col("type_text") != "", F.col("type_text")).otherwise(F.col("name_line")))
    return (df.withColumn("role", role)
            .withColumn("result_kind", F.when(F.col("role") == "x_other", F.when(shown == "", F.lit("Other result")).otherwise(shown))
                        .otherwise(F.lit("")))
            .select(key, "letter", "model", "unit", "role", "result_kind", "has_header", "is_result"))


def fallback_role(read: DataFrame, edges: DataFrame, key: str = "image_id") -> DataFrame:
    """Pictures whose title block gave no role: told apart by the share of edge pixels, or left open."""
    df = read.join(edges.select(key, "edge_density"), key, "left")
    no_role, bare = F.col("role").isNull(), ~F.col("has_header")
    guess = F.when(F.col("edge_density") > fixed.MESH_EDGE, F.lit("mesh")).otherwise(F.lit("geometry"))
    note = (F.when(F.col("role") == "x_other", X.fill(
        "Result type '{k}' is not Total Deformation or Equivalent (von-Mises) Stress, so it is used as an additional view."
        " Change it in the table if that is wrong.", k="result_kind"))
        .when(no_role & ~bare, F.lit("Title not recognised - please choose what this picture is.")))
    confidence = F.when((F.col("role") == "x_other") | (no_role & bare), F.lit("medium")).otherwise(F.lit("high"))
    return df.withColumns({"note": note, "confidence": confidence,
                           "role": F.when(no_role & bare, guess).otherwise(F.coalesce("role", F.lit("unknown")))})


def route_read_or_manual(read: DataFrame, pictures: DataFrame, key: str = "image_id", ocr: bool = True) -> DataFrame:
    """Pictures that were read in time keep the reading; the others are told by their name, with the reason.

    ``read`` has one row per attempted picture: role, confidence, letter, failure (null when all went well).
    """
    good = read.filter(F.col("failure").isNull()) if ocr else read.filter(F.lit(False))
    known = good.select(key, "role", "confidence", "letter").join(pictures.select(key, "name"), key)
    known = known.select(key, "name", "role", "confidence", "letter", F.lit(False).alias("manual"), F.lit(None).cast("string").alias("note"))
    rest = pictures.select(key, "name").join(good.select(key), key, "left_anti")
    why = read.select(key, "failure").filter(F.col("failure").isNotNull()) if ocr else read.select(key, F.lit("ocr").alias("failure")).filter(F.lit(False))
    rest = rest.join(why, key, "left").withColumn("failure", F.coalesce("failure", F.lit("ocr")))
    rest = classify_by_name(rest)
    note = (F.when((F.col("role") == "unknown") & (F.col("failure") == "ocr"),
                   F.lit("I could not tell what this picture is - please choose it in the list."))
            .when(F.col("role") == "unknown", X.fill("This picture could not be read automatically ({w}) - please choose what it is.", w="failure"))
            .when(F.col("failure") != "ocr", X.fill(
                "This picture could not be read automatically ({w}) - its type was guessed from the file name; please check it"
                " and type the numbers.", w="failure")))
    rest = rest.select(key, "name", "role", "confidence", "letter", F.lit(True).alias("manual"), note.alias("note"))
    return known.unionByName(rest)


def ocr_budget(calls: DataFrame, picture_seconds: float = fixed.PICTURE_SECONDS, call_seconds: float = fixed.CALL_SECONDS,
               key: str = "image_id", hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Time each call may take. A call is refused when a second or less is left; sums are exact decimals."""
    df = calls.withColumn("__sec", F.col("seconds").cast("decimal(18,6)"))
    df = skew.prefix_sum(df, [key], ["call_no"], "__sec", [skew.slice_of("call_no")], "__used", before=True, hot_rows=hot_rows)
    left = F.lit(picture_seconds) - F.col("__used").cast("double")
    df = df.withColumn("used", F.col("__used").cast("double")).withColumn("admitted", left > 1)
    df = df.withColumn("cap_seconds", F.when(F.col("admitted"), F.least(F.lit(call_seconds), left)))
    failed = ~F.col("admitted") | (F.col("seconds") > F.col("cap_seconds"))
    df = skew.attach(df.drop("__sec", "__used"), [key], hot_rows, few_groups=True, picture_timed_out=F.bool_or(failed))
    return df


def first_accepting_region(reads: DataFrame, key: str = "image_id") -> DataFrame:
    """First region with a title block or a role; when there is none, the last one tried."""
    accepted = F.col("has_header") | F.col("role").isNotNull()
    return reads.groupBy(key).agg(F.coalesce(F.min(F.when(accepted, F.col("ordinal"))), F.max("ordinal")).alias("region"))


def candidate_regions(pictures: DataFrame, region: str = "header") -> DataFrame:
    """Regions to try, best first: the fractional box; for large pictures also pixel boxes of three screen scales.

    A box counts only if it is not too small and differs from every box accepted before it.
    """
    frac, px = fixed.REGIONS[region]
    base = F.array(*[F.lit(float(v)) for v in frac])

    def scaled(u):
        return F.array(*[F.least(F.lit(1.0), F.lit(float(p)) * u / F.col("width" if i % 2 == 0 else "height")) for i, p in enumerate(px)])

    def far(box, kept):
        gap = F.aggregate(F.zip_with(box, kept, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
        return gap > 0.03

    def step(acc, u):
        box = scaled(u)
        wide = (box[2] - box[0] > 0.02) & (box[3] - box[1] > 0.02)
        return F.when(wide & F.forall(acc, lambda kept: far(box, kept)), F.concat(acc, F.array(box))).otherwise(acc)

    large = (F.col("width") > 1300) | (F.col("height") > 800)
    scales = F.when(large, F.array(*[F.lit(u) for u in (1.0, 1.5, 2.0)])).otherwise(F.array().cast("array<double>"))
    boxes = F.aggregate(scales, F.array(base), step)
    keep = [c for c in ("job_id", "id", "image_id") if c in pictures.columns]
    df = pictures.select(*keep, F.posexplode(boxes).alias("ordinal", "box"))
    return df.select(*keep, F.col("ordinal").cast("long").alias("ordinal"),
                     *[F.col("box")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
