"""Suitability: response curves and their product, as expressions on a field.

A field has h, slope_deg and, where used, moisture, curvature and aspect_rad.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .maths import clamp, logistic

SEA_LEVEL = 62


def foliage_slope(theta: Column) -> Column:
    return logistic(0.4 * (theta - 32.0))


def treeline(h: Column) -> Column:
    return F.when(h <= 180, 1.0).when(h <= 225, (225.0 - h) / 45.0).otherwise(0.0)


def above_water(h: Column, sea_level: int = SEA_LEVEL) -> Column:
    return F.when(h <= sea_level + 1.0, 0.0).otherwise(1.0)


def rock(theta: Column) -> Column:
    return logistic(-0.5 * (theta - 38.0))


def snow(h: Column, theta: Column) -> Column:
    return clamp((h - 200.0) / 40.0, 0.0, 1.0) * (1.0 - 0.6 * F.sin(F.radians(theta)))


def ground(theta: Column) -> Column:
    """soil below 35 degrees, rock above 45; between, mixed."""
    return F.when(theta < 35, "soil").when(theta > 45, "rock").otherwise("mixed")


def riverbed(area: Column, least: float = 500.0) -> Column:
    """Riverbed scree: the share by which the drainage area exceeds a channel's least. Our own form."""
    return clamp((area - least) / least, 0.0, 1.0)


def product(*responses: Column, moisture: Column | None = None, curvature: Column | None = None, aspect: Column | None = None) -> Column:
    """The product of responses; moisture, curvature and aspect count as 1 unless given."""
    out = F.lit(1.0)
    for r in (*responses, *(c for c in (moisture, curvature, aspect) if c is not None)):
        out = out * r
    return out


def moist(moisture: Column) -> Column:
    """Rises to 1 at half of the greatest moisture. This and the next three are our own forms."""
    return clamp(2.0 * moisture, 0.0, 1.0)


def hollow(curvature: Column) -> Column:
    """0 on the sharpest ridges, 1 in the deepest hollows."""
    return 0.5 * (1.0 + curvature)


def shaded(aspect: Column) -> Column:
    """Half to 1: least where the downhill direction's angle is pi."""
    return 0.75 + 0.25 * F.cos(aspect)


def boulder(theta: Column, curvature: Column) -> Column:
    """Erratic boulders: on gentle, even ground."""
    return logistic(0.5 * (theta - 30.0)) * (1.0 - F.abs(curvature))


def catalogue(theta: Column, h: Column, sea_level: int = SEA_LEVEL, moisture: Column | None = None, curvature: Column | None = None, aspect: Column | None = None, area: Column | None = None) -> dict[str, Column]:
    """Suitability by feature. Foliage takes the factors that are given; boulders ask for a curvature, riverbed scree for an area."""
    more = {"moisture": moisture, "curvature": curvature, "aspect": aspect}
    forms = {"moisture": moist, "curvature": hollow, "aspect": shaded}
    out = {
        "foliage": product(treeline(h), foliage_slope(theta), above_water(h, sea_level), **{k: forms[k](v) for k, v in more.items() if v is not None}),
        "rock": rock(theta),
        "snow": snow(h, theta),
    }
    if curvature is not None:
        out["boulder"] = boulder(theta, curvature)
    if area is not None:
        out["scree"] = riverbed(area, 10.0)
    return out


def suitability(field: DataFrame, features: dict[str, Column] | None = None, digits: int = 9) -> DataFrame:
    """Long form (z, x, feature, p), p rounded before any threshold reads it."""
    features = features or catalogue(F.col("slope_deg"), F.col("h"))
    each = F.array(*[F.struct(F.lit(k).alias("feature"), F.round(p, digits).alias("p")) for k, p in features.items()])
    return field.select("z", "x", F.explode(each).alias("s")).select("z", "x", "s.feature", "s.p")
