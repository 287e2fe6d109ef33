"""Numbers, confidences, boxes and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d on doubles."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def to_number(c: Column) -> Column:
    """A finite double or null (NM2)."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def confidence(c: Column) -> Column:
    """Percent or share as a share, 2 decimals; null outside 0 to 100 (NM1)."""
    n = to_number(c)
    share = F.when((n > 1) & (n <= 100), n / 100).when((n >= 0) & (n <= 1), n)
    return F.round(share, 2)


#: Fixed value: USD for one credit of the scrape service, unless configured.
USD_PER_CREDIT = 0.00015


def amount_usd(amount: Column, currency: Column, usd_per_credit: float = USD_PER_CREDIT) -> Column:
    """USD as it is, credits by their rate, other currencies null; 6 decimals (NM3)."""
    a = amount.cast("decimal(18,6)")
    by = F.when(currency == "USD", a).when(currency == "SCRAPFLY_CREDIT", (a * F.lit(str(usd_per_credit)).cast("decimal(10,6)")).cast("decimal(24,12)"))
    return F.round(by, 6).cast("decimal(18,6)")


def token_usd(input_tokens: Column, output_tokens: Column, input_per_million: float, output_per_million: float) -> Column:
    """Cost of a model call by tokens, 6 decimals (NM4)."""
    rate = lambda r: F.lit(str(r)).cast("decimal(12,6)")
    total = F.coalesce(input_tokens, F.lit(0)).cast("decimal(18,0)") * rate(input_per_million) + F.coalesce(output_tokens, F.lit(0)).cast("decimal(18,0)") * rate(output_per_million)
    return F.round(total / F.lit(1_000_000), 6).cast("decimal(18,6)")


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _side(box: Column, i: int) -> Column:
    return F.get(box, F.lit(i)).cast("double")


def bbox_area(box: Column) -> Column:
    """Area of [x0, y0, x1, y1] whatever the corners' order; null unless there are four finite numbers (NM5)."""
    area = F.abs(_side(box, 2) - _side(box, 0)) * F.abs(_side(box, 3) - _side(box, 1))
    return F.when(F.size(box) == 4, to_number(area))


def bbox_signed_area(box: Column) -> Column:
    """As :func:`bbox_area`, but a reversed box has no area."""
    side = lambda hi, lo: F.greatest(F.lit(0.0), _side(box, hi) - _side(box, lo))
    return F.when(F.size(box) == 4, to_number(side(2, 0) * side(3, 1)))


def crop_rectangle(box: Column, width: Column, height: Column, pad: float = 0.15) -> Column:
    """struct(left, top, width, height) in pixels of a padded box, inside the image, one pixel a side at least (NM5).

    Corners come in any order. A box that is not four finite numbers is the whole image (a null among four counts as 0);
    null for an image without size.
    """
    side = lambda i: F.coalesce(_side(box, i), F.lit(0.0))
    usable = F.coalesce((F.size(box) == 4) & F.forall(box, lambda v: v.isNull() | to_number(v.cast("double")).isNotNull()), F.lit(False))
    at = lambda i: F.when(usable, side(i)).otherwise(F.lit(float(i // 2)))
    px = lambda v: F.floor(v + 0.5).cast("int")

    def along(lo: Column, hi: Column, size: Column) -> tuple[Column, Column]:
        a, b = F.least(lo, hi), F.greatest(lo, hi)
        start, stop = clamp01(a - (b - a) * pad), clamp01(b + (b - a) * pad)
        first = F.least(px(start * size), (size - 1).cast("int"))
        return first, F.least(F.greatest(F.lit(1), px((stop - start) * size)), size.cast("int") - first)

    (left, across), (top, down) = along(at(0), at(2), width), along(at(1), at(3), height)
    out = F.struct(left.alias("left"), top.alias("top"), across.alias("width"), down.alias("height"))
    return F.when((width > 0) & (height > 0), out)


#: Turn in degrees of an orientation that a detection may state; any other needs none. Fixed values.
TURNS = {"vertical_up": -90, "vertical_down": 90}


def rotation(orientation: Column) -> Column:
    """Degrees by which a crop is turned so that its spine can be read (NM5)."""
    return F.coalesce(*[F.when(orientation == name, turn) for name, turn in TURNS.items()], F.lit(0))
