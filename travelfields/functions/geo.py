"""Distances on the plane that touches the earth at the mean latitude."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from travelfields.config import M_PER_DEG


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular metres."""
    mean = F.radians((lat1 + lat2) / 2)
    dy, dx = (lat2 - lat1) * M_PER_DEG, (lon2 - lon1) * M_PER_DEG * F.cos(mean)
    return F.sqrt(dx * dx + dy * dy)


def in_bbox(lat: Column, lon: Column, bbox: dict) -> Column:
    """Inclusive on all sides."""
    return lat.between(bbox["lat_min"], bbox["lat_max"]) & lon.between(bbox["lon_min"], bbox["lon_max"])
