"""Column expressions of the inventory: row maths, strings, predicates."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def slot_index(ts: Column, origin: str, seconds: int) -> Column:
    """Number of the slot of `seconds` that ts is in, counted from the origin; floors before it too."""
    passed = F.timestamp_diff("SECOND", F.lit(origin).cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return F.floor(passed / seconds).cast("long")


def slot_of_day(slot: Column, per_day: int) -> Column:
    """P02."""
    return F.pmod(slot, F.lit(per_day)).cast("long")


def day_of(slot: Column, per_day: int) -> Column:
    """P02."""
    return F.floor(slot / per_day).cast("long")


def weekday_of(slot: Column, per_day: int, first: int = 0) -> Column:
    """0 is Monday; `first` is the weekday of slot 0."""
    return F.pmod(day_of(slot, per_day) + first, F.lit(7)).cast("long")


def week_fold(slot: Column, per_day: int, folds: int) -> Column:
    """Weeks dealt to folds in turn."""
    return F.pmod(F.floor(day_of(slot, per_day) / 7), F.lit(folds)).cast("long")


def active(value: Column, cut: Column, eligible: Column) -> Column:
    """At or under the cut and eligible; a missing value is not active."""
    return F.coalesce(value <= cut, F.lit(False)) & eligible


def clean_number(value: Column) -> Column:
    """NaN as NULL, as every source should have it."""
    return F.when(~F.isnan(value), value)


def sanitise_probability(p: Column) -> Column:
    """NaN to 0.5, infinities and what lies outside to the nearer of 0 and 1."""
    return F.when(F.isnan(p), 0.5).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def clip(value: Column, low: float, high: float) -> Column:
    """P08; NULL stays NULL."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def bin_of(ratio: Column, edges: list[float], labels: list[str]) -> Column:
    """P10: label of the right-closed interval (edges[k], edges[k+1]]; NULL outside."""
    out = F.lit(None).cast("string")
    for low, high, label in list(zip(edges[:-1], edges[1:], labels, strict=True))[::-1]:
        out = F.when((ratio > low) & (ratio <= high), label).otherwise(out)
    return out


def logit_shift(p: Column, by: float, eps: float = 1e-6) -> Column:
    """sigmoid(logit(p) + by), p clipped to [eps, 1 - eps] first."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return 1 / (1 + F.exp(-(F.log(q / (1 - q)) + by)))


def reconcile(first: Column, second: Column, product: Column, share: float, most: float, gate: Column | None = None) -> tuple[Column, Column]:
    """Moves first and second so that second / first comes nearer to product, in logarithms.

    r = ln(second / (first * product)), clipped to +-most; first takes share * r, second gives (1 - share) * r. Rows
    without positive values or outside the gate stay.
    """
    fits = (first > 0) & (second > 0) & (product > 0)
    if gate is not None:
        fits = fits & gate
    r = clip(F.log(second / (first * product)), -most, most)
    return F.when(fits, first * F.exp(share * r)).otherwise(first), F.when(fits, second * F.exp((share - 1) * r)).otherwise(second)


def apply_ratio(first: Column, second: Column, ratio: Column, share: float) -> tuple[Column, Column]:
    """First * ratio^-share and second * ratio^(1 - share); without a positive ratio both stay."""
    ok = F.coalesce(ratio > 0, F.lit(False))
    return F.when(ok, first * F.pow(ratio, F.lit(-share))).otherwise(first), F.when(ok, second * F.pow(ratio, F.lit(1 - share))).otherwise(second)


def diagram(speed: Column, flow: Column, free_speed: Column, capacity: Column, jam_density: Column) -> dict[str, Column]:
    """Triangular-diagram features of a cell: critical density, wave speed, density, congested flow, implied speed, speed ratio."""
    critical = capacity / free_speed
    wave = capacity / (jam_density - critical)
    density = flow / F.greatest(speed, F.lit(1.0))
    return {
        "k_crit": critical,
        "wave": wave,
        "density": density,
        "q_congested": F.greatest(wave * (jam_density - density), F.lit(0.0)),
        "v_implied": F.when(density <= critical, free_speed).otherwise(F.greatest(wave * (jam_density / density - 1), F.lit(0.0))),
        "v_ratio": speed / free_speed,
    }


def axial_difference(a: Column, b: Column) -> Column:
    """smallest angle between two axes, in degrees."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def derived_length(thickness: Column, angle: Column) -> Column:
    """thickness / sin(angle), NULL where the angle has no sine."""
    s = F.sin(F.radians(angle))
    return F.when(s > 0, thickness / s)


def line_meet(m1: Column, c1: Column, m2: Column, c2: Column) -> tuple[Column, Column]:
    """where y = m1 x + c1 meets y = m2 x + c2; NULLs for parallels."""
    x = F.when(F.abs(m1 - m2) > 1e-12, (c2 - c1) / (m1 - m2))
    return x, m1 * x + c1


def point_line_distance(x: Column, y: Column, m: Column, c: Column) -> Column:
    """F12."""
    return F.abs(m * x - y + c) / F.sqrt(m * m + 1)


def guarded_blend(reference: Column, estimate: Column, weight: float, most: float) -> Column:
    """reference + weight * clip(estimate - reference); without an estimate the reference."""
    return reference + weight * F.coalesce(clip(estimate - reference, -most, most), F.lit(0.0))


def null_sentinel(value: Column, sentinel: float) -> Column:
    """NULL where value is close to the sentinel."""
    return F.when(~(F.abs(value - sentinel) <= 1e-8 + 1e-5 * abs(sentinel)), value)


def _ranges(letters: list[str], gap: int) -> str:
    """A pattern's class of the letters, and of those between any two that are at most `gap` apart."""
    out: list[list[int]] = []
    for code in map(ord, letters):
        if out and code - out[-1][1] <= gap:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


@functools.cache
def _decomposed() -> tuple[str, str, dict[str, str], str, str]:
    """By Unicode's compatibility decomposition without combining marks: letters that become one letter and what each becomes,
    those that become several or none, a pattern that finds these among others, and one of marks. Hangul syllables, which
    have no accents, are left out."""
    ones, several, marks = {}, {}, []
    for code in range(0x80, 0x1F000):
        letter = chr(code)
        if 0xAC00 <= code < 0xD7A4 or 0xD800 <= code < 0xE000:
            continue
        if unicodedata.combining(letter):
            marks.append(letter)
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if plain != letter:
            (ones if len(plain) == 1 else several)[letter] = plain
    return "".join(ones), "".join(ones.values()), several, _ranges(list(several), 16), r"(?:(?=\p{M})" + _ranges(marks, 1) + ")+"


def normalise_text(text: Column) -> Column:
    """compatibility letters without accents, lower case, single spaces. Texts of ASCII letters skip the first step."""
    ones, becomes, several, maybe, marks = _decomposed()
    clean = F.coalesce(text, F.lit(""))
    table = F.map_from_arrays(F.split(F.lit(" ".join(several)), " "), F.split(F.lit("\x01".join(several.values())), "\x01"))
    spread = F.array_join(F.transform(F.split(clean, ""), lambda c: F.when(c.rlike(maybe), F.coalesce(F.element_at(table, c), c)).otherwise(c)), "")
    plain = F.regexp_replace(F.translate(F.when(clean.rlike(maybe), spread).otherwise(clean), ones, becomes), marks, "")
    return F.regexp_replace(F.lower(F.when(clean.rlike(r"[^\x00-\x7F]"), plain).otherwise(clean)), r"(?U)\s+", " ")


def stem(name: Column) -> Column:
    """text before the last underscore."""
    return F.regexp_replace(name, "_[^_]*$", "")


def natural_key(name: Column, width: int = 12) -> Column:
    """digit runs padded with zeros, so that text order is number order."""
    padded = F.regexp_replace(name, r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, r"0*(\d{%d})" % width, "$1")


def fingerprint(*parts: str) -> str:
    """16 hex digits of a schema's ordered names."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(list(parts)).encode()).hexdigest()[:16]
