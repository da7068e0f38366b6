"""Fixed values of the model, all of them parameters of the operators that use them."""

import math

EARTH_RADIUS_M = 6_371_000.0
M_PER_DEG = math.pi * EARTH_RADIUS_M / 180

# Road classes, free-flow km/h and road group.
GROUPS = ("autopista", "arterial", "local")
ROAD_CLASSES = (
    ("motorway", 100, 0), ("motorway_link", 60, 0), ("trunk", 80, 0), ("trunk_link", 50, 0),
    ("primary", 60, 1), ("primary_link", 40, 1), ("secondary", 50, 1), ("secondary_link", 35, 1),
    ("tertiary", 40, 2), ("tertiary_link", 30, 2), ("unclassified", 30, 2), ("residential", 30, 2), ("living_street", 15, 2),
)
NO_DELAY_GROUP = 0

# Time slots as (slot, label, day, hour, copy_of).
SLOTS = (
    ("madrugada", "Madrugada (referencia sin tráfico)", "martes", "03:00", None),
    ("punta_am", "Punta mañana", "martes", "08:00", None),
    ("valle", "Valle / horario normal", "martes", "13:00", None),
    ("punta_pm", "Punta tarde", "martes", "18:30", None),
    ("noche", "Noche", "martes", "21:30", None),
    ("sabado", "Sábado (como ciudad vacía)", "sábado", "12:00", "madrugada"),
    ("domingo", "Domingo (como ciudad vacía)", "domingo", "12:00", "madrugada"),
)
FITTED_SLOTS = tuple(s[0] for s in SLOTS if s[4] is None)

# Priors as slot -> (t0_s, g autopista, g arterial, g local, d_s), and bounds of the five.
PRIORS = {
    "madrugada": (60.0, 1.0, 1.0, 1.0, 8.0),
    "punta_am": (150.0, 1.35, 1.3, 1.15, 30.0),
    "valle": (110.0, 1.1, 1.15, 1.05, 18.0),
    "punta_pm": (160.0, 1.45, 1.4, 1.2, 33.0),
    "noche": (80.0, 1.0, 1.05, 1.0, 12.0),
}
BOUNDS = ((30.0, 240.0), (0.7, 6.0), (0.7, 6.0), (0.7, 6.0), (0.0, 60.0))
RIDGE, HUBER_S, ROBUST_PASSES, ROUTE_PASSES, DAMPING = 0.15, 240.0, 3, 5, 0.6

# The graph's box, spacings and radii, bands, trips and default slots.
GRAPH_BBOX = {"lat_min": -33.52, "lat_max": -33.15, "lon_min": -70.82, "lon_max": -70.44}
GRID_SPACING_M, MAX_SEGMENT_M, SNAP_RADIUS_M, SNAP_BUCKET_M = 150.0, 350.0, 300.0, 400.0
RASTER_CELL_M, RASTER_RADIUS, BANDS, HEAT_QUANTILE = 120.0, 2, (15.0, 25.0, 40.0), 0.95
MAX_TRIPS, DEFAULT_TRIPS = 14, 4
DEFAULT_SLOT_OUT, DEFAULT_SLOT_BACK = "punta_am", "punta_pm"

# Metrics as (metric, label, unit, divisor, uses time, fixed slot).
METRICS = (
    ("tiempo", "Tiempo con tráfico", "min", 60.0, True, None),
    ("flujo_libre", "Tiempo de madrugada", "min", 60.0, True, "madrugada"),
    ("distancia", "Distancia recorrida", "km", 1000.0, False, None),
)

# Heat-map colours from low to high cost.
HEAT_RAMP = ((0, 104, 55), (49, 163, 84), (166, 217, 106), (255, 255, 191), (253, 174, 97), (244, 109, 67), (165, 0, 38))

# Columns of the measurement template, and those that people fill in.
MEASUREMENT_COLUMNS = ("id_par", "franja", "dia", "hora_salida", "origen", "destino", "minutos", "minutos_min", "minutos_max", "notas")
TYPED_COLUMNS = ("minutos", "minutos_min", "minutos_max", "notas")

#: Costs of edges and trips are multiples of this part of a second (or metre): doubles sum such numbers exactly, in any order.
COST_UNIT = 2.0**-30
