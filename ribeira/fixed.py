"""Names, word lists, limits and tables that results depend on."""

from __future__ import annotations

# --- Fixed values: census sectors -------------------------------------------------------------
STATE_CODE = "15"
SECTOR_KEY = "CD_SETOR"
DEMOGRAPHY_KEY = "CD_setor"
MUNICIPALITY_KEY = "CD_MUN"
POPULATION_TOTAL = "V01006"
POPULATION_MALE = "V01007"
POPULATION_FEMALE = "V01008"
FEMALE_AGE_GROUPS = [
    "V01020", "V01021", "V01022", "V01023", "V01024", "V01025",
    "V01026", "V01027", "V01028", "V01029", "V01030",
]
MEASURES = [POPULATION_TOTAL, POPULATION_MALE, POPULATION_FEMALE, *FEMALE_AGE_GROUPS]
BASIC_POPULATION = "v0001"
STATUS_OBSERVED = "observed"
STATUS_LEFT_ONLY = "zero_population_not_in_demography"
STATUS_UNAVAILABLE = "female_population_unavailable"
SUMMARY_COLUMNS = [
    "CD_SETOR", "CD_MUN", "NM_MUN", "SITUACAO", "CD_SIT", "CD_TIPO", "AREA_KM2",
    "total_population", "V01007", "female_population", "population_data_status",
]

# --- Fixed values: links and landed files ----------------------------------------------------
DATA_EXTENSIONS = [".zip", ".csv", ".json", ".geojson", ".kml", ".kmz", ".gpkg", ".shp"]
BLOCKED_HOSTS = ["facebook.com", "www.facebook.com", "api.whatsapp.com", "twitter.com", "x.com"]
# Text inside an outputFormat value -> file extension; the first line that matches wins.
OUTPUT_FORMATS = [
    ("shape-zip", ".zip"),
    ("shapefile", ".zip"),
    ("json", ".geojson"),
    ("csv", ".csv"),
    ("kml", ".kml"),
]
SOURCE_KEYWORDS = {
    "dnit_roads": ["rodov", "shapefile", "shp", "snv", "geo"],
    "mapbiomas_state_roads": ["rodovia", "estadual", "shp", "zip"],
    "mapbiomas_federal_roads": ["rodovia", "federal", "shp", "zip"],
    "mapbiomas_other_roads": ["outros-trechos", "outros", "trechos", "shp", "zip"],
    "antaq_ports": ["porto", "instala", "travess", "geograf", "shp", "kml"],
    "antaq_waterways": ["hidrovia", "navega", "via interior", "geograf", "shp"],
    "decea_airports": ["airport", "aerodromo", "aeródromo", "wfs", "getfeature"],
}
BOUNDARY_SOURCE = "ibge_municipal_boundaries"
SCORE_TERM, SCORE_EXTENSION, SCORE_FORMAT, SCORE_FEATURE_REQUEST, SCORE_GOVERNMENT = 3, 5, 8, 4, 2
MIN_SCORE = 5
MAX_CANDIDATES = 3
MAX_BYTES = 80_000_000

# --- Fixed values: travel-time scenarios ------------------------------------------------------
COMPONENTS = ["access", "waiting", "in_vehicle", "transfer", "egress"]
MODES = {"walking": True, "road": True, "river": True, "air": False}
# Scenario -> (waiting counts, transfers count); None means that the caller has to decide.
SCENARIOS = {
    "theoretical_minimum": (False, True),
    "local_access": (False, True),
    "motorized": (False, True),
    "operational": (True, True),
    "emergency": (None, True),
    "flood_season": (True, True),
    "dry_season": (True, True),
}
THRESHOLDS_MINUTES = [30, 60, 120, 180, 240]

# --- Fixed values: official transport sources -------------------------------------------------
# Fields that are not given are null.
SOURCE_CATALOG = [
    {
        "source_id": "dnit_roads",
        "agency": "DNIT",
        "theme": "roads",
        "official_page": "https://www.gov.br/dnit/pt-br/assuntos/atlas-e-mapas/pnv-e-snv",
        "expected_formats": ["shp", "geojson", "csv"],
        "map_reference_year": 2021,
        "download_enabled": False,
        "direct_urls": [
            "https://geoservicos.inde.gov.br/geoserver/DNIT/ows?service=WFS&version=1.0.0&request=GetFeature&typeName=DNIT:cide_2021_&outputFormat=SHAPE-ZIP",
            "https://geoservicos.inde.gov.br/geoserver/DNIT/ows?service=WFS&version=2.0.0&request=GetFeature&typeNames=DNIT:cide_2021_&outputFormat=application/json",
            "https://geoservicos.inde.gov.br/geoserver/DNIT/ows?service=WFS&version=2.0.0&request=GetFeature&typeNames=DNIT:cide_2021_&outputFormat=SHAPE-ZIP",
        ],
    },
    {
        "source_id": "mapbiomas_state_roads",
        "agency": "MapBiomas",
        "theme": "state_roads",
        "official_page": "https://brasil.mapbiomas.org/dados-de-infraestrutura/",
        "expected_formats": ["shp"],
        "map_reference_year": 2023,
        "direct_urls": ["https://brasil.mapbiomas.org/wp-content/uploads/sites/4/2023/08/rodovia-estadual.zip"],
        "direct_urls_only": True,
        "expected_sha256": "364a070e9394a812b8eab3956c6056203decfde66d7771c679854d28d8b4fe05",
    },
    {
        "source_id": "mapbiomas_federal_roads",
        "agency": "MapBiomas",
        "theme": "federal_roads",
        "official_page": "https://brasil.mapbiomas.org/dados-de-infraestrutura/",
        "expected_formats": ["shp"],
        "map_reference_year": 2023,
        "direct_urls": ["https://brasil.mapbiomas.org/wp-content/uploads/sites/4/2023/08/rodovia-federal.zip"],
        "direct_urls_only": True,
        "expected_sha256": "f507e9c2bdca50c1ee6814c07cd220c88e686c0aae2b88ca8baef0280d01ba94",
    },
    {
        "source_id": "mapbiomas_other_roads",
        "agency": "MapBiomas",
        "theme": "other_road_segments",
        "official_page": "https://brasil.mapbiomas.org/dados-de-infraestrutura/",
        "expected_formats": ["shp"],
        "map_reference_year": 2023,
        "direct_urls": ["https://brasil.mapbiomas.org/wp-content/uploads/sites/4/2023/08/outros-trechos.zip"],
        "direct_urls_only": True,
        "expected_sha256": "7df6c217fe2ea6bbfd556863fe21a426003042ad774ac7c73bf38e41d58d1585",
    },
    {
        "source_id": "antaq_ports",
        "agency": "ANTAQ",
        "theme": "ports",
        "official_page": "https://www.gov.br/antaq/pt-br/central-de-conteudos/informacoes-geograficas",
        "expected_formats": ["shp", "kml"],
        "map_reference_year": 2025,
    },
    {
        "source_id": "antaq_waterways",
        "agency": "ANTAQ",
        "theme": "waterways",
        "official_page": "https://www.gov.br/antaq/pt-br/central-de-conteudos/informacoes-geograficas",
        "expected_formats": ["shp"],
        "map_reference_year": 2022,
    },
    {
        "source_id": "decea_airports",
        "agency": "DECEA/ICA",
        "theme": "airports",
        "official_page": "https://geoaisweb.decea.gov.br/geoserver/ICA/ows?service=WFS&version=2.0.0&request=GetCapabilities",
        "expected_formats": ["shp", "geojson", "csv"],
        "map_reference_year": 2026,
        "direct_urls": [
            "https://geoaisweb.decea.gov.br/geoserver/ICA/ows?service=WFS&version=1.0.0&request=GetFeature&typeName=ICA:airport&outputFormat=SHAPE-ZIP",
            "https://geoaisweb.decea.gov.br/geoserver/ICA/ows?service=WFS&version=2.0.0&request=GetFeature&typeNames=ICA:airport&outputFormat=application/json",
            "https://geoaisweb.decea.gov.br/geoserver/ICA/ows?service=WFS&version=2.0.0&request=GetFeature&typeNames=ICA:airport&outputFormat=SHAPE-ZIP",
        ],
    },
    {
        "source_id": "ibge_municipal_boundaries",
        "agency": "IBGE",
        "theme": "municipal_boundaries",
        "official_page": "https://geoftp.ibge.gov.br/organizacao_do_territorio/malhas_territoriais/malhas_municipais/municipio_2023/UFs/PA/PA_Municipios_2023.zip",
        "metadata_page": "https://www.ibge.gov.br/geociencias/organizacao-do-territorio/malhas-territoriais/15774-malhas.html",
        "expected_formats": ["shp"],
        "map_reference_year": 2023,
        "expected_sha256": "0996ffd1b26928dfbd518f67339baa36fd860f50693c1c156f9b4d86fb77c7ad",
    },
]
