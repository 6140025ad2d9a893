"""Scalar derivations (B16-B29): categories, bands, engineered features,
road-reference parsing, property extraction, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Curve categories by absolute radius.
CURVE_STRAIGHT = "Rett veg"
CURVE_VERY_GENTLE = "Veldig slak sving (svingradius {r}m)"
CURVE_GENTLE = "Slak sving (svingradius {r}m)"
CURVE_SHARP = "Krapp sving"
CURVE_UNKNOWN = "Ukjent"
TURN_LABEL = "Sving (svingradius {r}m)"

# Risk bands.
BAND_LOW = "lav sannsynlighet for avslag"
BAND_MEDIUM = "medium sannsynlighet for avslag"
BAND_HIGH = "høy sannsynlighet for avslag"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _num_text(c: Column) -> Column:
    """Python-style text of a double (``1500.0``, ``1234.5``)."""
    return c.cast("double").cast("string")


def _with_radius(label: str, radius: Column) -> Column:
    """A label with its radius; NULL without one."""
    before, after = label.split("{r}")
    return F.concat(F.lit(before), radius, F.lit(after))


def curve_category(radius) -> Column:
    """Category of a horizontal curve from |radius|; NULL -> unknown."""
    r = F.abs(_c(radius).cast("double"))
    txt = _num_text(r)
    return (F.when(r >= 3000, F.lit(CURVE_STRAIGHT))
            .when(r >= 1000, _with_radius(CURVE_VERY_GENTLE, txt))
            .when(r >= 500, _with_radius(CURVE_GENTLE, txt))
            .when(r >= 0, F.lit(CURVE_SHARP))
            .otherwise(F.lit(CURVE_UNKNOWN)))


def turn_label(category, radius) -> Column:
    """A sharp curve is shown with its absolute radius, others as they are."""
    txt = _num_text(F.abs(_c(radius).cast("double")))
    return F.when(_c(category) == F.lit(CURVE_SHARP),
                  _with_radius(TURN_LABEL, txt)).otherwise(_c(category))


def risk_band(p, scale: float = 1.0) -> Column:
    """Band of a reject probability; ``scale=100`` for percent input."""
    v = _c(p)
    return (F.when(v < 0.05 * scale, F.lit(BAND_LOW))
            .when(v < 0.50 * scale, F.lit(BAND_MEDIUM))
            .otherwise(F.lit(BAND_HIGH)))


def per_access(aadt, accesses) -> Column:
    """Traffic per access point, ``aadt / (accesses + 1)``."""
    return _c(aadt) / (_c(accesses) + F.lit(1))


def curve_indicator(radius) -> Column:
    """0 when |r| > 99000 (straight), else 1."""
    return F.when(F.abs(_c(radius)) > 99000, F.lit(0)).otherwise(F.lit(1))


def gradient_indicator(gradient) -> Column:
    """1 when |g| > 0.1, else 0."""
    return F.when(F.abs(_c(gradient)) > 0.1, F.lit(1)).otherwise(F.lit(0))


def curve_sigmoid(radius) -> Column:
    """1/(1+exp(-0.001|r|)) when |r| < 99000, else 0."""
    r = F.abs(_c(radius))
    return F.when(r < 99000, F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-0.001) * r))).otherwise(F.lit(0.0))


def long_vehicles(aadt, share) -> Column:
    """Long vehicles per day, ``aadt * share / 100``."""
    return _c(aadt) * _c(share) / F.lit(100)


# The ten serving interaction features, as products of the
# five inputs (after |.|), with their display names.
SERVING_FEATURES = [
    ("aadt_x_access_x_gradient", ("aadt", "accesses", "gradient"),
     "Total trafikkmengde per år × antall avkjørsler × kurvatur, stigning"),
    ("aadt_x_access", ("aadt", "accesses"),
     "Total trafikkmengde per år × antall avkjørsler"),
    ("aadt_x_long", ("aadt", "long"),
     "Total trafikkmengde per år × antall tunge kjøretøy per år"),
    ("share_x_access_x_long", ("share", "accesses", "long"),
     "Andel tunge kjøretøy per år × antall avkjørsler × antall tunge kjøretøy per år"),
    ("access_x_gradient_x_long", ("accesses", "gradient", "long"),
     "Antall avkjørsler × kurvatur, stigning × antall tunge kjøretøy per år"),
    ("aadt_x_access_x_long", ("aadt", "accesses", "long"),
     "Total trafikkmengde per år × avkjørsler × antall tunge kjøretøy per år"),
    ("access_x_long", ("accesses", "long"),
     "Antall avkjørsler × antall tunge kjøretøy per år"),
    ("aadt_x_gradient", ("aadt", "gradient"),
     "Total trafikkmengde per år × kurvatur, stigning"),
    ("aadt_x_share", ("aadt", "share"),
     "Total trafikkmengde per år × andel tunge kjøretøy"),
    ("aadt_x_speed_x_access", ("aadt", "speed", "accesses"),
     "Total trafikkmengde per år × fartsgrense × antall avkjørsler"),
]


def serving_features(aadt, share, speed, accesses, gradient) -> list[Column]:
    """The ten serving products.  One shared definition for fit and serve:
    ``share`` is the long-vehicle share in percent, ``long`` = aadt*share/100."""
    base = {
        "aadt": _c(aadt).cast("double"),
        "share": _c(share).cast("double"),
        "speed": _c(speed).cast("double"),
        "accesses": _c(accesses).cast("double"),
        "gradient": F.abs(_c(gradient).cast("double")),
    }
    base["long"] = long_vehicles(base["aadt"], base["share"])
    out = []
    for name, parts, _ in SERVING_FEATURES:
        e = base[parts[0]]
        for p in parts[1:]:
            e = e * base[p]
        out.append(e.alias(name))
    return out


def serving_display_names() -> dict[str, str]:
    return {n: d for n, _, d in SERVING_FEATURES}


def road_part(ref) -> Column:
    """Road part of a linear reference = text before `` m``."""
    return F.split(_c(ref), " m", 2).getItem(0)


def road_meter(ref) -> Column:
    """Meter value after `` m`` up to an optional `` K…`` suffix; NULL if none."""
    m = F.regexp_extract(_c(ref), r" m([0-9.]+)", 1)
    return F.when(m == "", F.lit(None).cast("double")).otherwise(m.try_cast("double"))


def first_property(props, name: str, default: str = "") -> Column:
    """Value of the first ``{name, value}`` element whose name matches."""
    hit = F.filter(_c(props), lambda p: p["name"] == F.lit(name))
    return F.coalesce(F.try_element_at(hit, F.lit(1))["value"], F.lit(default))


def display_label(case_number, purpose, road_ref, municipality, received) -> Column:
    """One-line case label for pick lists."""
    def s(c):
        return F.coalesce(_c(c).cast("string"), F.lit(""))
    return F.concat(F.lit("Saksnr: "), s(case_number), F.lit(" | For "), F.lower(s(purpose)),
                    F.lit(" på "), F.split(s(road_ref), " ").getItem(0), F.lit(" i "),
                    s(municipality), F.lit(" mottatt "), s(received))


def received_date(text) -> Column:
    """Day-first date text -> date; malformed -> NULL."""
    return F.try_to_date(_c(text), "dd.MM.yyyy")
