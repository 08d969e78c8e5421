"""Column expressions for days, volumes, names and draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Response classes under each scheme.
RESPONSE_SCHEMES: dict[str, dict[str, int]] = {
    "multiclass": {"CR": 0, "PR": 1, "SD": 2, "PD": 3},
    "binary": {"CR": 0, "PR": 0, "SD": 1, "PD": 1},
    "1v3": {"CR": 0, "PR": 1, "SD": 1, "PD": 1},
    "sota": {"CR": 0, "PR": 0, "SD": 0, "PD": 1},
}
#: Thresholds of partial response and of stable disease, for volumes and for diameters.
RESPONSE_THRESHOLDS = {"3d": (0.343, 1.728), "1d": (0.7, 1.2)}
DAY_US = 86_400_000_000


def days_between(a: Column | str, b: Column | str) -> Column:
    """Whole days from b to a, rounded down (so half a day back is -1)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.floor(F.timestamp_diff("MICROSECOND", b, a) / F.lit(float(DAY_US))).cast("int")


def interpolate_linear(dt1: Column, v1: Column, dt2: Column, v2: Column) -> Column:
    """Value at 0 of the line through (dt1, v1) and (dt2, v2), not below 0; null for dt1 = dt2."""
    slope = (v2 - v1) / F.nullif(dt2 - dt1, F.lit(0)).cast("double")
    return F.when(slope.isNotNull(), F.greatest(F.lit(0.0), v1 - dt1 * slope))


def sphere_diameter(volume: Column) -> Column:
    return 2 * F.pow(volume / F.lit(4.0 / 3.0 * 3.141592653589793), F.lit(1.0 / 3.0))


def centroid_distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def compose_id(patient: Column, number: Column) -> Column:
    return F.concat_ws(":", patient.cast("string"), number.cast("string"))


def patient_of(lesion: Column) -> Column:
    return F.split_part(lesion, F.lit(":"), F.lit(1))


def parse_session_ts(name: Column) -> Column:
    """Timestamp of `ses-YYYYMMDDHHMMSS`, also with a `tX - ` before it; null for other names."""
    digits = F.regexp_extract(name, r"^(?:t\d+ - )?(?:ses-)?(\d{14})$", 1)
    return F.when(digits != "", F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))).cast("timestamp_ntz")


def session_name(ts: Column) -> Column:
    return F.concat(F.lit("ses-"), F.date_format(ts, "yyyyMMddHHmmss"))


def to_numeric(c: Column) -> Column:
    """As double; text that is no number is null."""
    return c.try_cast("double")


def encode_response(c: Column, scheme: str = "multiclass", keep_unknown: bool = False) -> Column:
    """Integer of a class; others become null, or stay if they are integers already."""
    pairs = [x for k, v in RESPONSE_SCHEMES[scheme].items() for x in (F.lit(k), F.lit(v))]
    code = F.create_map(*pairs)[c]
    return F.coalesce(code, c.try_cast("int")) if keep_unknown else code


def response(volume: Column, baseline: Column, nadir: Column, mode: str = "3d") -> Column:
    """Class of a volume given the first one and the smallest so far; null where the baseline is 0 and the volume is not."""
    th1, th2 = RESPONSE_THRESHOLDS[mode]
    return (
        F.when(volume == 0, "CR").when(baseline == 0, None).when(volume / F.nullif(baseline, F.lit(0.0)) <= th1, "PR")
        .when(volume / F.greatest(nadir, F.lit(1e-6)) < th2, "SD").when(volume.isNotNull() & baseline.isNotNull(), "PD")
    )


def draw(*parts: Column | str | int) -> Column:
    """A number from 0 to 2^32 - 1 that depends on its parts only: the first bits of an MD5."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
