"""Column types and fixed values shared by every operator.

A *record* is a row with a unique ``row_idx`` (or another id column), one or
more text columns and an ``entities`` array.  Offsets are code-point offsets,
half open, exactly as ``substring`` and ``length`` count them in Spark.
"""

from __future__ import annotations

from pyspark.sql import types as T

SPAN = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("label", T.StringType()),
])

ENTITY = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("score_original", T.DoubleType()),
    T.StructField("score_calibrated", T.DoubleType()),
    T.StructField("score_context_boosted", T.DoubleType()),
])

TOKEN_SPAN = T.StructType([
    T.StructField("start_tok", T.IntegerType()),
    T.StructField("end_tok", T.IntegerType()),
    T.StructField("label", T.StringType()),
])

ENTITY_ARRAY = T.ArrayType(ENTITY)
SPAN_ARRAY = T.ArrayType(SPAN)

# ---------------------------------------------------------------------------
# Names and constants of the data format.
# ---------------------------------------------------------------------------
LABELS = ("Person", "Location", "Organization")
TEXT_FIELDS = ("relato", "text", "texto", "description", "descricao")
TRAINING_TEXT_FIELDS = ("text", "relato", "texto", "descricao", "description")
INFERENCE_FIELDS = (
    "assunto", "relato", "bairroLocal", "logradouroLocal", "cidadeLocal", "pontodeReferenciaLocal",
)
METADATA_FIELDS = ("logradouroLocal", "bairroLocal", "cidadeLocal", "pontodeReferenciaLocal")
RANK_SCORE_FIELDS = ("score_context_boosted", "score_calibrated", "score", "score_ts")
QUALITY_SCORE_FIELDS = ("score_context_boosted", "score_calibrated", "score")
BOOST_FALLBACK_FIELDS = ("score_calibrated", "score_ts", "score_iso")
CALIBRATION_COLUMNS = (
    "RowId", "Label", "Entidade_Referencia", "Entidade_Predita", "Start", "End", "Score", "Validacao",
)
NER_LABEL_MAP = {
    "PERSON": "Person", "PER": "Person", "ORG": "Organization",
    "GPE": "Location", "LOC": "Location", "FAC": "Location",
}
GENERIC_TERMS = {
    "Person": ["cidadao", "cidadaos", "morador", "moradores", "pessoa", "pessoas",
               "envolvido", "envolvidos"],
    "Location": ["casa", "casas", "local"],
}
STOPWORDS = (
    "a", "ao", "as", "da", "das", "de", "do", "dos", "e", "em", "na", "nas", "no", "nos",
    "o", "os", "ou", "para", "por", "pra", "pro", "que", "um", "uma",
)
MODEL_MARKERS = ("[", "]", "CLS", "SEP")
SCORE_EPS = 1e-6
NLL_EPS = 1e-12
