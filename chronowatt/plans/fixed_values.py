"""Fixed values of the studied region: code maps, station lists, windows.

They must equal what the producers publish; nothing here is computed.
"""

from __future__ import annotations

ZONE = "Europe/Paris"
TERRITORY = "Corse"
AIR_ORGANISATION = "QUALITAIR CORSE"
EXPECTED_SUFFIX = "+00:00"

# Generation codes to fuel categories (labels of the load curve). B10 is pumped-storage output and
# leaves hydro by decision: it returns energy produced elsewhere, so it is carried but not counted.
FUEL_OF_CODE = {
    "B01": "bioenergies",
    "B02": "thermique",
    "B03": "thermique",
    "B04": "thermique",
    "B05": "thermique",
    "B06": "thermique",
    "B07": "thermique",
    "B08": "thermique",
    "B09": "autre",
    "B10": "step",
    "B11": "hydraulique",
    "B12": "hydraulique",
    "B13": "autre",
    "B14": "autre",
    "B15": "autre",
    "B16": "solaire",
    "B17": "bioenergies",
    "B18": "eolien",
    "B19": "eolien",
    "B20": "thermique",
    "B25": "autre",
    "charge": "charge",
}
PRIMARY_FUELS = ("thermique", "hydraulique", "solaire", "eolien", "bioenergies", "autre")
CARRIED_FUELS = ("step", "charge")

# Columns of the load curve that are always filled; a NULL there is an incident.
ALWAYS_FILLED = (
    "production_totale_mw",
    "thermique_mw",
    "hydraulique_mw",
    "photovoltaique_mw",
    "eolien_mw",
    "bioenergies_mw",
    "importations_mw",
)

# Weather quality codes: 0 protected, 1 validated, 9 filtered are kept; 2 is doubtful.
QUALITY_KEPT = (0, 1, 9)
QUALITY_DROPPED = (2,)

# Installations of the emissions register (the ids are only unique within a country).
EMITTERS = {1040: "EDF Vazzio", 1041: "EDF Lucciana", 206030: "EDF PEI Haute-Corse"}
EMITTERS_COUNTRY = "FR"
EMISSION_YEARS = (2019, 2024)

GENERATION_YEARS = (2019, 2020, 2021, 2022, 2023, 2024)
FLOW_YEARS = (2020, 2021, 2023)
FLOW_DIRECTIONS = ("entrant", "sortant")
# Net import of the interconnector published by the operator, GWh: a value to compare with.
PUBLISHED_NET_GWH = {2020: 393, 2021: 418, 2023: 396}

# code, name, latitude, longitude, altitude (m), in service since, setting, influence
AIR_STATIONS = (
    ("FR41001", "AJACCIO CANETTO", 41.924694, 8.735694, 39, "2006-05-23", "Urbaine", "Fond"),
    ("FR41002", "BASTIA GIRAUD", 42.697918, 9.446417, 60, "2006-08-01", "Urbaine", "Fond"),
    ("FR41004", "BASTIA LA MARANA", 42.535830, 9.475972, 15, "2007-01-03", "Périurbaine", "Industrielle"),
    ("FR41017", "BASTIA MONTESORO", 42.671333, 9.434639, 15, "2006-05-23", "Périurbaine", "Fond"),
    ("FR41024", "VENACO", 42.236027, 9.190028, 653, "2011-04-29", "Rurale régionale", "Fond"),
    ("FR41063", "AJACCIO CONFINA 2", 41.947685, 8.796159, 70, "2024-01-31", "Périurbaine", "Fond"),
)
AIR_STATIONS_SCHEMA = (
    "code_site string, station string, latitude double, longitude double, altitude int, "
    "mise_en_service string, implantation string, influence string"
)
# air station -> weather post
AIR_TO_WEATHER = (
    ("FR41001", "20004014"),
    ("FR41002", "20033015"),
    ("FR41004", "20148001"),
    ("FR41017", "20033015"),
    ("FR41024", "20354008"),
    ("FR41063", "20004002"),
)
POLLUTANT_OF_CODE = ((7, "O3"), (8, "NO2"))

STUDY_YEARS = (2020, 2025)
QUALITY_OBJECTIVE = 120.0  # µg/m³ as the daily maximum of the 8-hour mean; strictly above counts
INFORMATION_LEVEL = 180.0  # µg/m³ as an hourly mean; at or above counts

# Primary-energy balance of the region, 2020, in % (published by its observatory).
PRIMARY_BALANCE_2020 = {
    "petrole": 76.8,
    "liaisons": 9.3,
    "grande_hydro": 6.2,
    "autres_enr": 4.33,
    "solaire": 3.4,
}

# Source ids of the long air series, which must equal those of the registry.
AIR_SOURCES = (
    "aee_no2_ajaccio_canetto_continu",
    "aee_no2_ajaccio_canetto_valide",
    "aee_no2_ajaccio_confina2_continu",
    "aee_no2_ajaccio_confina2_valide",
    "aee_no2_bastia_giraud_continu",
    "aee_no2_bastia_giraud_valide",
    "aee_no2_bastia_marana_continu",
    "aee_no2_bastia_marana_valide",
    "aee_no2_bastia_montesoro_continu",
    "aee_no2_bastia_montesoro_valide",
    "aee_o3_ajaccio_canetto_continu",
    "aee_o3_ajaccio_canetto_valide",
    "aee_o3_ajaccio_confina2_continu",
    "aee_o3_ajaccio_confina2_valide",
    "aee_o3_bastia_giraud_continu",
    "aee_o3_bastia_giraud_valide",
    "aee_o3_bastia_marana_continu",
    "aee_o3_bastia_marana_valide",
    "aee_o3_bastia_montesoro_continu",
    "aee_o3_bastia_montesoro_valide",
    "aee_o3_venaco_continu",
    "aee_o3_venaco_valide",
)

# Coverage of the study. Summer months; stations that measure each pollutant; first summer of those that
# opened inside the window; last summer of those that closed.
AIR_SUMMER_MONTHS = (6, 7, 8)
STATIONS_OF_POLLUTANT = {
    "O3": ("AJACCIO CANETTO", "AJACCIO CONFINA 2", "BASTIA GIRAUD", "BASTIA LA MARANA", "BASTIA MONTESORO", "VENACO"),
    "NO2": ("AJACCIO CANETTO", "AJACCIO CONFINA 2", "BASTIA GIRAUD", "BASTIA LA MARANA", "BASTIA MONTESORO"),
}
FIRST_SUMMER = {"AJACCIO CONFINA 2": 2024}
LAST_SUMMER: dict[tuple[str, str], int] = {}

# What each source must look like (ids as in the registry): format, delimiter, columns, root.
SALES_COLUMNS = ("nature_mutation", "valeur_fonciere", "nom_commune", "code_commune")
WEATHER_COLUMNS = ("NUM_POSTE", "NOM_USUEL", "AAAAMMJJHH", "T", "QT")
AIR_COLUMNS = ("Samplingpoint", "Start", "End", "Value", "Validity", "Verification")
SOURCE_CONTRACTS = {
    "dvf_2a_2024": ("csv.gz", ",", SALES_COLUMNS, None),
    "dvf_2b_2024": ("csv.gz", ",", SALES_COLUMNS, None),
    "edf_mix_temps_reel": ("csv", ";", ("date", "total", "photovoltaique", "filiere_enr_distrib", "statut"), None),
    "edf_courbe_charge_horaire": ("csv", ";", ("territoire", "date_heure", "production_totale_mw", "photovoltaique_mw", "statut"), None),
    "edf_ecretement_corse": ("csv", ",", ("Territoire", "Mois", "Durée (h)"), None),
    "seqe_emissions_verifiees": ("csv", ",", ("country_code", "eutl_id", "name", "year", "emissions_tco2e"), None),
    "lcsqa_temps_reel": ("csv", ";", ("Zas", "nom site", "Polluant", "valeur", "validité"), None),
    "meteo_horaire_corse": ("csv.gz", ";", WEATHER_COLUMNS, None),
    "meteo_horaire_corse_2020_2024": ("csv.gz", ";", WEATHER_COLUMNS, None),
    **{f"entsoe_sardaigne_{y}": ("xml", None, (), "GL_MarketDocument") for y in GENERATION_YEARS},
    **{f"entsoe_charge_sardaigne_{y}": ("xml", None, (), "GL_MarketDocument") for y in GENERATION_YEARS},
    **{f"entsoe_sarco_{y}_{d}": ("xml", None, (), "Publication_MarketDocument") for y in FLOW_YEARS for d in FLOW_DIRECTIONS},
    **{source: ("parquet", None, AIR_COLUMNS, None) for source in AIR_SOURCES},
}
