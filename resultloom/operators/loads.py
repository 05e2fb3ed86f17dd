"""Setup lists: loads and supports out of recognised lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs as X, fixed
from ..plans import skew

_SETUP = "(?i)" + fixed.SETUP_WORDS


def clean_lines(lines: DataFrame) -> DataFrame:
    """Lines without the junk of the coloured letter boxes; only those that name a load or a support."""
    text = reduce(lambda t, junk: F.regexp_replace(t, junk, ""), fixed.SETUP_JUNK, X.collapse_ws("text"))
    return lines.withColumn("text", text).filter(F.col("text").rlike(_SETUP) & ~F.col("text").rlike(fixed.SETUP_NOT))


def best_region(lines: DataFrame, key: str = "image_id", hot_rows: int | None = skew.HOT_ROWS) -> DataFrame:
    """Lines of the region with the most lines, the earliest region on a tie."""
    lines = skew.settle(lines)
    counts = lines.groupBy(key, "ordinal").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy(key).agg(F.max_by("ordinal", F.struct("c", (-F.col("ordinal")).alias("o"))).alias("__best"), F.sum("c").alias("__size"))
    return skew.lookup(lines, best, [key], size="__size", hot_rows=hot_rows).filter(F.col("ordinal") == F.col("__best")).drop("__best")


def value_unit(c="text"):
    """Number and unit after the first colon of a line."""
    rest = F.regexp_extract(X.col(c), r"^[^:]*:(.*)$", 1)
    pattern = rf"^\s*({fixed.NUM})\s*(.*)$"
    return F.regexp_extract(rest, pattern, 1).try_cast("double"), F.trim(F.regexp_extract(rest, pattern, 2))


def load_type(c="text", value="value"):
    t, has = F.lower(X.col(c)), X.col(value).isNotNull()
    return (F.when(t.contains("gravity") | (t.contains("acceleration") & t.contains("standard")), F.lit("gravity"))
            .when(t.contains("pressure") & has, F.lit("pressure")).when(t.contains("moment") | t.contains("torque"), F.lit("moment"))
            .when(t.contains("force") & has, F.lit("force")).when(t.contains("cylindrical"), F.lit("cylindrical"))
            .when(t.contains("frictionless"), F.lit("frictionless")).when(t.contains("remote displacement"), F.lit("remote_displacement"))
            .when(t.contains("displacement"), F.lit("displacement")).when(t.contains("fixed"), F.lit("fixed"))
            .when(t.contains("temperature") & has, F.lit("temperature")).otherwise(F.lit("other")))


def normalise_loads(lines: DataFrame) -> DataFrame:
    """Every setup line as a load with its value in MPa, N·mm, N or °C, a drafted sentence, and whether it needs input."""
    value, unit = value_unit("text")
    df = lines.withColumn("value", value).withColumn("unit", unit).withColumn("load_type", load_type())
    u = F.lower(F.regexp_replace("unit", r"[\s\-*·•.]+", ""))
    factor = F.coalesce(*[F.when(u == k, F.lit(f)) for k, f in fixed.PRESSURE_TO_MPA.items()], F.lit(1.0))
    kind, v = F.col("load_type"), F.col("value")
    si = (F.when(kind == "pressure", v * factor).when(kind == "moment", v * F.when(u == "nm", 1000.0).when(u == "knm", 1e6).otherwise(1.0))
          .when(kind == "force", v * F.when(u == "kn", 1000.0).otherwise(1.0)).when(kind == "temperature", v))
    df = df.withColumn("value_si", si)
    water = F.col("value_si") * 1e6 / F.lit(fixed.WATER)
    whole = F.abs(water - F.rint(water)) < 0.002 * water
    say = fixed.SETUP_SAY
    text = (F.when(kind == "pressure", X.fill(say["pressure"], mm=F.when(whole, X.fixed_text(water, 0)).otherwise(X.fixed_text(water, 2)), mpa=X.sig_text("value_si")))
            .when((kind == "moment") & v.isNotNull(), X.fill(say["moment"], v=X.grouped_text("value_si"), nm=X.general_text(F.col("value_si") / 1000)))
            .when(kind == "moment", F.lit(say["moment_only"])).when(kind == "force", X.fill(say["force"], v=X.grouped_text("value_si")))
            .when(kind == "temperature", X.fill(say["temperature"], v=X.general_text("value"))).when(kind == "other", X.fill(say["other"], line="text")))
    fixed_say = F.coalesce(*[F.when(kind == k, F.lit(say[k])) for k in ("gravity", "cylindrical", "frictionless", "remote_displacement", "displacement", "fixed")])
    return df.withColumn("draft", F.coalesce(text, fixed_say)).withColumn("needs_input", ~kind.isin("gravity", "pressure", "temperature"))


def headline_load(c="text"):
    t = F.lower(X.col(c))
    return (F.when(t.contains("gravity"), F.lit("Self Weight")).when(t.contains("pressure"), F.lit("Pressure"))
            .when(t.contains("moment") | t.contains("torque"), F.lit("Moment")).when(t.contains("force"), F.lit("Force"))
            .when(t.contains("temperature"), F.lit("Temperature")))


def case_headline(lines: DataFrame, key: str = "case_id") -> DataFrame:
    """Name and subtitle of a case from its distinct loads in the order they first appear; one aggregation, at most four loads."""
    load = headline_load()
    df = lines.withColumn("__load", load)
    kinds = ("Pressure", "Moment", "Force", "Temperature")
    df = df.groupBy(key).agg(F.bool_or(F.coalesce(F.col("__load") == "Self Weight", F.lit(False))).alias("own"),
                             *[F.min(F.when(F.col("__load") == k, F.col("line_no"))).alias(k) for k in kinds])
    seen = F.array_sort(F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.col(k).alias("at"), F.lit(k).alias("k"))) for k in kinds])))
    df = df.withColumn("loads", F.transform(seen, lambda s: s["k"]))
    none = F.size("loads") == 0
    name = F.when(none, F.lit("")).when(F.size("loads") == 1, F.concat(F.get("loads", F.lit(0)), F.lit(" Only"))).otherwise(F.array_join("loads", " + "))
    full = F.concat(F.when(F.col("own"), F.array(F.lit("Self Weight"))).otherwise(F.array().cast("array<string>")), F.col("loads"))
    subtitle = F.when(none, F.lit("")).otherwise(F.concat(F.lit("("), F.array_join(full, " + "), F.lit(")")))
    return df.select(key, name.alias("name"), subtitle.alias("subtitle"))


def gravity_of(lines: DataFrame, key: str = "case_id") -> DataFrame:
    """Value and unit of the first gravity or acceleration line that holds a number."""
    value, unit = value_unit("text")
    t = F.lower(F.col("text"))
    unit = F.regexp_replace(unit, r"[?*\"'`]+$", "²")
    hit = F.when((t.contains("gravity") | t.contains("acceleration")) & value.isNotNull(), F.struct("line_no", value.alias("v"), unit.alias("u")))
    return lines.groupBy(key).agg(F.min(hit).alias("g")).select(key, F.col("g.v").alias("gravity"), F.col("g.u").alias("gravity_unit"))
