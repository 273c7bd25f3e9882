"""Table schemas and fixed values of the procurement-risk data model."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = T.StringType()
_WHEN = T.TimestampType()
_MONEY = T.DecimalType(20, 2)
_NUMBER = T.DecimalType(38, 6)

# Column names of the published contract-notice data set.
NOTICE_FIELDS = [
    # buyer
    ("entidad", _TEXT),
    ("nit_entidad", _TEXT),
    ("departamento_entidad", _TEXT),
    ("ciudad_entidad", _TEXT),
    ("ordenentidad", _TEXT),
    ("codigo_pci", _TEXT),
    ("codigo_entidad", _NUMBER),
    # process
    ("id_del_proceso", _TEXT),
    ("referencia_del_proceso", _TEXT),
    ("ppi", _TEXT),
    ("id_del_portafolio", _TEXT),
    ("nombre_del_procedimiento", _TEXT),
    ("descripci_n_del_procedimiento", _TEXT),
    ("fase", _TEXT),
    ("estado_del_procedimiento", _TEXT),
    ("id_estado_del_procedimiento", _NUMBER),
    ("estado_de_apertura_del_proceso", _TEXT),
    ("estado_resumen", _TEXT),
    # dates
    ("fecha_de_publicacion_del", _WHEN),
    ("fecha_de_ultima_publicaci", _WHEN),
    ("fecha_de_publicacion_fase", _WHEN),
    ("fecha_de_publicacion_fase_1", _WHEN),
    ("fecha_de_publicacion", _WHEN),
    ("fecha_de_publicacion_fase_2", _WHEN),
    ("fecha_de_publicacion_fase_3", _WHEN),
    ("fecha_de_recepcion_de", _WHEN),
    ("fecha_de_apertura_de_respuesta", _WHEN),
    ("fecha_de_apertura_efectiva", _WHEN),
    ("fecha_adjudicacion", _WHEN),
    # contracting
    ("precio_base", _MONEY),
    ("modalidad_de_contratacion", _TEXT),
    ("justificaci_n_modalidad_de", _TEXT),
    ("duracion", _NUMBER),
    ("unidad_de_duracion", _TEXT),
    ("tipo_de_contrato", _TEXT),
    ("subtipo_de_contrato", _TEXT),
    ("categorias_adicionales", _TEXT),
    ("codigo_principal_de_categoria", _TEXT),
    # buying unit
    ("ciudad_de_la_unidad_de", _TEXT),
    ("nombre_de_la_unidad_de", _TEXT),
    # counters
    ("proveedores_invitados", _NUMBER),
    ("proveedores_con_invitacion", _NUMBER),
    ("visualizaciones_del", _NUMBER),
    ("proveedores_que_manifestaron", _NUMBER),
    ("respuestas_al_procedimiento", _NUMBER),
    ("respuestas_externas", _NUMBER),
    ("conteo_de_respuestas_a_ofertas", _NUMBER),
    ("proveedores_unicos_con", _NUMBER),
    ("numero_de_lotes", _NUMBER),
    # award
    ("adjudicado", _TEXT),
    ("id_adjudicacion", _TEXT),
    ("codigoproveedor", _TEXT),
    ("departamento_proveedor", _TEXT),
    ("ciudad_proveedor", _TEXT),
    ("valor_total_adjudicacion", _MONEY),
    ("nombre_del_adjudicador", _TEXT),
    ("nombre_del_proveedor", _TEXT),
    ("nit_del_proveedor_adjudicado", _TEXT),
    # link
    ("urlproceso", _TEXT),
]

PROCESS_KEY = "id_del_proceso"

#: notices as landed: everything is text until ``coerce_types``
LANDED_SCHEMA = T.StructType([T.StructField(n, _TEXT) for n, _ in NOTICE_FIELDS])

#: notices as stored
RAW_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("fuente_id", T.IntegerType())]
    + [T.StructField(n, t) for n, t in NOTICE_FIELDS]
    + [T.StructField("sincronizado_en", _WHEN)]
)

# Fields checked by the quality rules.
REQUIRED_FIELDS = [
    "entidad",
    "nombre_del_proveedor",
    "valor_total_adjudicacion",
    "fecha_de_publicacion_del",
    "tipo_de_contrato",
]
FUTURE_DATE_FIELDS = [
    "fecha_de_publicacion_del",
    "fecha_adjudicacion",
    "fecha_de_ultima_publicaci",
    "fecha_de_apertura_efectiva",
]
AMOUNT_FIELDS = ["precio_base", "valor_total_adjudicacion"]

MISSING_FIELD = "MISSING_FIELD"
FUTURE_DATE = "FUTURE_DATE"
NEGATIVE_AMOUNT = "NEGATIVE_AMOUNT"

# Penalties of the confidence score.
PENALTY_MISSING = 20
PENALTY_NEGATIVE = 20
PENALTY_FUTURE = 40

# Columns a caller may analyse, filter or sort by.
NUMERIC_FIELDS = ["total_value", "base_price", "confidence", "n_missing"]
DATE_FIELDS = ["published_on", "awarded_on"]
SORT_FIELDS = {
    "valor": "total_value",
    "valor_total_normalizado": "total_value",
    "precio_base_normalizado": "base_price",
    "fecha": "published_on",
    "id": "id",
    "entidad": "buyer",
    "proveedor": "supplier",
    "riesgo": "confidence",
}

# Supplier names that stand for "unknown".
PLACEHOLDER_SUPPLIERS = [
    "NO DEFINIDO",
    "N/A",
    "SIN INFORMACION",
    "SIN INFORMACIÓN",
    "SIN REGISTRO",
]

# Detector thresholds.
IQR_FACTOR = 1.5
REPEAT_DAYS = 30
REPEAT_MAX_SCORE = 10.0
REPEAT_HIGH_DAYS = 5
REPEAT_MEDIUM_DAYS = 15
DIRECT_MIN_AWARDS = 3
DIRECT_SPAN_DAYS = 90
DIRECT_HIGH_PCT = 90
DIRECT_MEDIUM_PCT = 70
RISK_HIGH_SCORE = 5
RISK_MEDIUM_SCORE = 2
DEFAULT_WEIGHTS = {"OUTLIER": 1.0, "SHORT_REPEAT": 1.5, "DIRECT_AWARD": 2.0}

# Ingest settings.
FIRST_DAY = "2020-01-01"
SAMPLE_ROWS = 5

SYNC_STATES = ["EN_PROCESO", "EXITOSO", "ERROR"]
SYNC_OK, SYNC_ERROR = "EXITOSO", "ERROR"

CONTRACT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("raw_id", T.LongType()),
        T.StructField("process_id", _TEXT),
        T.StructField("buyer", _TEXT),
        T.StructField("buyer_tax_id", _TEXT),
        T.StructField("supplier", _TEXT),
        T.StructField("supplier_tax_id", _TEXT),
        T.StructField("published_on", T.DateType()),
        T.StructField("awarded_on", T.DateType()),
        T.StructField("total_value", _MONEY),
        T.StructField("base_price", _MONEY),
        T.StructField("contract_type", _TEXT),
        T.StructField("method", _TEXT),
        T.StructField("status", _TEXT),
        T.StructField("city", _TEXT),
        T.StructField("region", _TEXT),
        T.StructField("url", _TEXT),
        T.StructField("row_hash", _TEXT),
        T.StructField("is_incomplete", T.BooleanType()),
        T.StructField("is_suspicious", T.BooleanType()),
        T.StructField("n_missing", T.IntegerType()),
        T.StructField("missing_fields", T.ArrayType(_TEXT)),
        T.StructField("confidence", T.IntegerType()),
    ]
)
