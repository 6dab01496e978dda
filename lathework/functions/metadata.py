"""What of a photo's metadata may go into a request, and boxes in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import cocoa_date, finite, let, region_hint


def shape(latitude: Column, longitude: Column, taken: Column, path: Column, send: Column, hint: Column) -> Column:
    """(latitude, longitude, date, hint): place and date where ``send`` is on and they are finite; a region only where ``hint`` is on and no place is given.

    A switch that is not set is off.
    """
    on, hinted = F.coalesce(send, F.lit(False)), F.coalesce(hint, F.lit(False))
    gps = on & finite(latitude) & finite(longitude)
    region = let(region_hint(path), lambda r: F.when(hinted & ~gps & (r != ""), r))
    return F.struct(
        F.when(gps, latitude).alias("latitude"), F.when(gps, longitude).alias("longitude"), F.when(on, cocoa_date(taken)).alias("date"), region.alias("hint")
    )


def denormalized(box: Column, width: Column, height: Column) -> Column:
    """A box in shares of its frame in pixels, not rounded."""
    return F.array(F.get(box, F.lit(0)) * width, F.get(box, F.lit(1)) * height, F.get(box, F.lit(2)) * width, F.get(box, F.lit(3)) * height)
