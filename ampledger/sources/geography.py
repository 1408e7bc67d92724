"""Fixed places: districts by id and city centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ampledger.session import bounded

# District ids, their city and name.
DISTRICTS = {
    "manila": {
        1: "Tondo", 2: "Ermita", 3: "Malate", 4: "Paco", 5: "Pandacan", 6: "Port Area", 7: "Quiapo",
        8: "Sampaloc", 9: "San Andres", 10: "San Miguel", 11: "San Nicolas", 12: "Santa Ana",
        13: "Santa Cruz", 14: "Santa Mesa", 15: "Binondo", 16: "Intramuros", 17: "San Antonio",
        18: "Singalong", 19: "Moriones", 20: "Balic-Balic",
    },
    "quezon": {
        21: "Batasan Hills", 22: "Commonwealth", 23: "Fairview", 24: "Novaliches", 25: "Diliman",
        26: "Cubao", 27: "Kamuning", 28: "Libis", 29: "Project 4", 30: "Project 6", 31: "Project 8",
        32: "San Francisco Del Monte", 33: "Santa Mesa Heights", 34: "Talipapa", 35: "Teachers Village",
        36: "Baesa", 37: "Bagong Lipunan", 38: "Blue Ridge", 39: "Holy Spirit", 40: "Payatas",
    },
    "makati": {
        46: "Poblacion", 47: "Bel-Air", 48: "Forbes Park", 49: "Dasmariñas", 50: "Urdaneta", 51: "San Lorenzo",
    },
}

# City id, name, latitude and longitude of the centre.
CITIES = [
    ("manila", "Manila", 14.5995, 120.9842),
    ("quezon", "Quezon City", 14.6760, 121.0437),
    ("makati", "Makati", 14.5547, 121.0244),
    ("pasig", "Pasig", 14.5764, 121.0851),
    ("marikina", "Marikina", 14.6507, 121.1029),
    ("mandaluyong", "Mandaluyong", 14.5794, 121.0359),
    ("taguig", "Taguig", 14.5176, 121.0509),
    ("pateros", "Pateros", 14.5438, 121.0687),
    ("paranaque", "Parañaque", 14.4793, 121.0198),
    ("muntinlupa", "Muntinlupa", 14.3814, 121.0445),
    ("laspinas", "Las Piñas", 14.4453, 120.9830),
    ("pasay", "Pasay", 14.5378, 121.0014),
    ("caloocan", "Caloocan", 14.6574, 120.9832),
    ("malabon", "Malabon", 14.6621, 120.9570),
    ("navotas", "Navotas", 14.6691, 120.9412),
    ("valenzuela", "Valenzuela", 14.7008, 120.9830),
    ("sanjuan", "San Juan", 14.6019, 121.0355),
]


def districts(spark: SparkSession) -> DataFrame:
    """``barangay_id, city_id, barangay`` (46 rows)."""
    rows = [(i, city, name) for city, names in DISTRICTS.items() for i, name in names.items()]
    return bounded(spark.createDataFrame(rows, "barangay_id int, city_id string, barangay string"), len(rows))


def cities(spark: SparkSession) -> DataFrame:
    """``city_id, city_name, center_lat, center_lon`` (17 rows)."""
    return spark.createDataFrame(CITIES, "city_id string, city_name string, center_lat double, center_lon double")
