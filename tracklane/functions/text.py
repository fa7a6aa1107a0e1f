"""Column functions for times, names, dates and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabularies.
CLASSES = ("大型", "普通", "軽")
ACCEPTED, REJECTED, OPEN = "採用", "除外", "未確認"
DANGER = ("なし", "やや危険", "危険", "非常に危険")


def timecode(seconds: Column) -> Column:
    """[-]HH:MM:SS.mmm"""
    ms = F.round(F.abs(seconds) * 1000).cast("long")
    whole = F.floor(ms / 1000)
    sign = F.when((seconds < 0) & (ms > 0), "-").otherwise("")
    return F.concat(sign, F.format_string("%02d:%02d:%02d.%03d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, ms % 1000))


def parse_time(text: Column) -> Column:
    """Seconds of s, MM:SS or HH:MM:SS; null where a part is no number or negative, or where there are more parts.  A blank part is 0."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.when(F.trim(p) == "", 0.0).otherwise(F.trim(p).try_cast("double")))
    fine = (F.size(parts) <= 3) & F.forall(parts, lambda p: p.isNotNull() & ~F.isnan(p) & (p >= 0))
    return F.when(fine, F.aggregate(parts, F.lit(0.0), lambda total, p: total * 60 + p))


def excel_day(date: Column) -> Column:
    """Spreadsheet serial of a date."""
    return F.datediff(date, F.lit("1899-12-30").cast("date"))


def day_fraction(unix: Column, zone_hours: int = 9) -> Column:
    """Share of the local day that has passed."""
    return F.pmod(unix + zone_hours * 3600, F.lit(86400.0)) / 86400


def vehicle_class(name: Column) -> Column:
    low = F.lower(name)
    return F.when(name.isin(*CLASSES), name).when(low.isin("bus", "truck"), "大型").when(low.isin("kei", "light"), "軽").otherwise("普通")


def danger(level: Column) -> Column:
    out = F.lit(DANGER[0])
    for k, name in enumerate(DANGER):
        out = F.when(level == str(k), name).otherwise(out)
    return out


def safe_id(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(text, "[^0-9A-Za-z_-]", "_"), F.lit("")), F.lit("event"))


def stem(path: Column) -> Column:
    """File name without folders and the last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def stem_name(path: Column) -> Column:
    """File name without folders."""
    return F.substring_index(path, "/", -1)


def stem_time(name: Column) -> Column:
    """A whole file stem as a number, else the last number in it."""
    last = F.element_at(F.regexp_extract_all(name, F.lit(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"), F.lit(0)), -1)
    return F.coalesce(name.try_cast("double"), F.when(name.rlike(r"\d"), last).try_cast("double"))


def number(text: Column) -> Column:
    """A number, or null for blank and invalid texts."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin("1", "true", "yes"), F.lit(False))


def scaled(values: Column, scale: Column) -> Column:
    """Each value by its own divisor; the last divisor repeats, zero divides by nothing."""

    def one(v: Column, i: Column) -> Column:
        d = F.try_element_at(scale, F.least(i + 1, F.size(scale)))
        return F.when(F.coalesce(d, F.lit(0.0)) == 0, v).otherwise(v / F.nullif(d, F.lit(0.0)))

    return F.transform(values, one)


def shown(value: Column, digits: int = 2) -> Column:
    """Rounded for a report; null where it is null or not finite."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), F.round(value, digits))


def minutes_text(seconds: Column) -> Column:
    """Whole minutes and seconds, as 1分30秒; null counts as 0, halves round up."""
    total = F.floor(F.coalesce(seconds, F.lit(0.0)) + 0.5)
    t = F.abs(total)
    return F.concat(F.when(total < 0, "-").otherwise(""), F.floor(t / 60).cast("string"), F.lit("分"), (t % 60).cast("string"), F.lit("秒"))


def _let(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f names it."""
    return F.transform(F.array(value), f)[0]


def _product(value: Column, scale: Column) -> Column:
    """A product p of doubles and its rounding error e (Dekker): their sum is exact."""
    big = 134217729.0
    high = lambda x: x * big - (x * big - x)

    def parts(x: Column) -> Column:
        v, s = x["v"], x["s"]
        return F.struct(v.alias("v"), s.alias("s"), high(v).alias("h"), high(s).alias("g"))

    def product(x: Column) -> Column:
        v, s, h, g = (x[c] for c in "vshg")
        return F.struct((v * s).alias("p"), (((h * g - v * s) + h * (s - g) + (v - h) * g) + (v - h) * (s - g)).alias("e"))

    return _let(_let(F.struct(value.alias("v"), scale.alias("s")), parts), product)


def general(value: Column, digits: int = 15) -> Column:
    """A number with so many significant digits and no zeros behind them, with an exponent below 1e-4 and from 10**digits on.

    Halves of the last digit are decided by the double as it is, but for exponents
    where the power of ten is no exact double: there by its shortest text.
    """
    bare = lambda s: F.regexp_replace(s, r"\.?0*$", "")

    def rounded(x: Column) -> Column:
        half = x["p"] - F.floor(x["p"]) == 0.5
        return F.when(half & (x["e"] > 0), F.ceil(x["p"])).when(half & (x["e"] < 0), F.floor(x["p"])).otherwise(F.rint(x["p"]).try_cast("long")).cast("string")

    def split(text: Column) -> Column:
        power = F.substring_index(text, "e", -1)
        return F.struct(F.regexp_replace(F.substring_index(text, "e", 1), r"\.", "").alias("figures"), power.alias("raised"), power.cast("int").alias("power"))

    def exact(v: Column, t: Column) -> Column:
        places = digits - 1 - t["power"]
        fine = places.between(0, 22)
        whole = _let(_product(F.abs(v), F.pow(F.lit(10.0), F.when(fine, places).otherwise(0).cast("double"))), rounded)
        figures = _let(whole, lambda w: F.when(fine & (F.length(w) == digits), w).otherwise(t["figures"]))
        return F.struct(figures.alias("figures"), t["raised"].alias("raised"), t["power"].alias("power"))

    def shape(t: Column) -> Column:
        figures, power = t["figures"], t["power"]
        large = F.concat(F.substring(figures, F.lit(1), power + 1), F.lit("."), F.substring(figures, power + 2, F.lit(digits)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), figures)
        raised = F.concat(bare(F.concat(F.substring(figures, 1, 1), F.lit("."), F.substring(figures, 2, digits))), F.lit("e"), t["raised"])
        return F.when((power < -4) | (power >= digits), raised).when(power >= 0, bare(large)).otherwise(bare(small))

    def written(v: Column) -> Column:
        text = _let(_let(_let(F.format_string(f"%.{digits - 1}e", F.abs(v)), split), lambda t: exact(v, t)), shape)
        finite = F.concat(F.when(v < 0, "-").otherwise(""), text)
        return F.when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), F.when(v > 0, "inf").otherwise("-inf")).when(v.isNotNull(), finite)

    return _let(value.cast("double"), written)


def round_exact(value: Column, digits: int) -> Column:
    """The nearest number of so many decimals to the double as it is; only true halves go to the even side.

    The rounding error of the value's product with 2 * 10**digits tells on which
    side of a seeming half it lies.
    """

    def nearest(x: Column) -> Column:
        p, e = x["p"], x["e"]
        half = (p == F.rint(p)) & (F.abs(p % 2) == 1)
        whole = F.when(half & (e > 0), (p + 1) / 2).when(half & (e < 0), (p - 1) / 2).otherwise(F.rint(p / 2))
        return F.when(F.abs(p) < 2.0**53, whole / 10.0**digits)

    return _let(value.cast("double"), lambda v: F.coalesce(_let(_product(v, F.lit(2.0 * 10.0**digits)), nearest), v))


def collection_date(text: Column, folder: Column) -> Column:
    """A date as 2026-07-01, 2026/07/01 or 260701; else that at the beginning of a folder's name (260701_1); null where neither is one."""
    text = F.trim(text)
    lead = F.regexp_extract(folder, r"^(\d{6})_", 1)
    year = lambda two: F.when(two < 69, 2000 + two).otherwise(1900 + two)
    part = lambda c, a: F.substring(c, a, 2).try_cast("int")
    date = lambda y, c: F.to_date(F.try_make_timestamp(y, part(c, 3), part(c, 5), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")))
    dashed = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(text, F.lit("y-M-d")).cast("date"))
    slashed = F.when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_timestamp(text, F.lit("y/M/d")).cast("date"))
    short = F.when(text.rlike(r"^\d{6}$"), date(year(part(text, 1)), text))
    return F.coalesce(dashed, slashed, short, F.when(lead != "", date(2000 + part(lead, 1), lead)))


def event_seconds(value: Column, fallback: Column) -> Column:
    """A finite number, else that of the other text, else 0."""
    finite = lambda c: F.when(F.abs(number(c)) < float("inf"), number(c))
    return F.coalesce(finite(value), finite(fallback), F.lit(0.0))


def column_letters(index: Column) -> Column:
    """Letters of a spreadsheet's column: 0 is A, 26 is AA (up to three)."""
    letter = lambda k: F.char(65 + k.cast("int"))
    i = index.cast("long")
    two, three = F.floor((i - 26) / 26), F.floor((i - 702) / 676)
    tail = letter(F.pmod(i, F.lit(26)))
    return (
        F.when(i < 26, tail).when(i < 702, F.concat(letter(two), tail))
        .otherwise(F.concat(letter(three), letter(F.pmod(F.floor((i - 702) / 26), F.lit(26))), tail))
    )
