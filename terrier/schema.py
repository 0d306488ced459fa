"""The deed schema and the fixed values of the deed domain."""

from __future__ import annotations

from datetime import date

from terrier.operators.price_stats import Level, PriceRoles

# The columns of a deed line, in file order.
DEED_LINE = """
id_mutation string, date_mutation string, numero_disposition bigint, nature_mutation string,
valeur_fonciere double, adresse_numero string, adresse_suffixe string, adresse_nom_voie string,
adresse_code_voie string, code_postal string, code_commune string, nom_commune string,
code_departement string, ancien_code_commune string, ancien_nom_commune string,
id_parcelle string, ancien_id_parcelle string, numero_volume string,
lot1_numero string, lot1_surface_carrez double, lot2_numero string, lot2_surface_carrez double,
lot3_numero string, lot3_surface_carrez double, lot4_numero string, lot4_surface_carrez double,
lot5_numero string, lot5_surface_carrez double, nombre_lots bigint,
code_type_local string, type_local string, surface_reelle_bati double,
nombre_pieces_principales bigint, code_nature_culture string, nature_culture string,
code_nature_culture_speciale string, nature_culture_speciale string, surface_terrain double,
longitude double, latitude double
"""

# Words and codes of the deed files.
NULL_TOKENS = ("", "NA", "null")
SALE_NATURES = ("Vente", "Vente en l'état futur d'achèvement", "Adjudication")
HOUSE, FLAT, OUTBUILDING = "Maison", "Appartement", "Dépendance"
LAND_USE = ("code_nature_culture", "code_nature_culture_speciale", "nature_culture",
            "nature_culture_speciale")
MIN_VALUE = 100.0
REFERENCE_YEAR = 2025

DISPOSITION = ("id_mutation", "numero_disposition")
USE_GROUP = (*DISPOSITION, "id_parcelle", "nature_mutation")
OUTBUILDING_GROUP = (*DISPOSITION, "id_parcelle", "nature_culture", "nature_culture_speciale",
                     "nature_mutation")
FIRSTS = ("date_mutation", "nature_mutation", "valeur_fonciere", "adresse_numero",
          "adresse_suffixe", "adresse_nom_voie", "adresse_code_voie", "code_postal",
          "code_commune", "nom_commune", "code_departement", "code_type_local", "type_local",
          "longitude", "latitude", "has_dependency", "surface_batie_totale")
LISTS = ("id_parcelle", "surface_reelle_bati", "code_nature_culture", "nature_culture",
         "code_nature_culture_speciale", "nature_culture_speciale", "surface_terrain",
         "prix_de_vente")
SUMS = ("nombre_pieces_principales",)

# Open bounds of a credible sale, and the fence settings.
BOUNDS = {"surface_batie_totale": (5, 1000), "valeur_fonciere": (10_000, 10_000_000),
          "prix_m2": (400, 30_000), "nombre_pieces_principales": (0, 20)}
FENCE_MIN_ROWS, FENCE_WIDTH = 10, 1.5

# Time spans, open-ended, and geographic levels.
SPANS = {"2025": date(2025, 1, 1), "2024": date(2024, 1, 1), "2023": date(2023, 1, 1), "all": None}
ROLES = PriceRoles(house=HOUSE, flat=FLAT)
LEVELS = {
    "country": Level((), big=True, constants={"country": "France"}),
    "region": Level(("code_region", "nom_region"), big=True),
    "department": Level(("code_departement", "code_region", "nom_region"), big=True),
    "commune": Level(("code_commune", "nom_commune")),
    "iris": Level(("code_iris", "nom_iris"), not_null="code_iris"),
    "parcel": Level(("id_parcelle_unique",), firsts=("code_departement", "code_commune")),
}

# The cities made of numbered districts, and their own codes.
DISTRICTS = {"Paris": range(75101, 75121), "Marseille": range(13201, 13217),
             "Lyon": range(69381, 69390)}
DISTRICT_CITY = {str(code): city for city, codes in DISTRICTS.items() for code in codes}
CITY_CODES = ("75056", "69123", "13055")
TOP_CITIES = 50

# Simplification in degrees per map layer, and the colour scale.
TOLERANCE = {"country": 0.005, "regions": 0.002, "departments": 0.001, "communes": 0.0005,
             "iris": None, "parcels": 0.00001}
SCALE_LOW, SCALE_HIGH, SCALE_MIN_SALES = 1500.0, 8000.0, 5
