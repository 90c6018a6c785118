"""Fixed values.

Everything in this module must equal the original pipeline's output for the
results to match: labels of the text header, of the run summary and of the
readable report, the texts of fallback and error records, the truncation
marker and the chunk label.  They are listed plainly, in the order in which
they appear in the output.  Prompt wording is *not* fixed (see prompts.py);
only its slots, the ``-----`` separators and the JSON keys are.
"""

# --- fixed values: text header (one line each, in this order) -------------
HEADER_TITLE = "Título: "
HEADER_AUTHORS = "Autores: "
HEADER_ARXIV = "ArXiv ID: "
HEADER_SECTION = "Sección: "
HEADER_PART = "Parte: "
HEADER_TOTAL = "Total de partes: "

# --- fixed values: names of the sections found by the cascade -------------
PREAMBLE_SECTION = "preambulo"
DEFAULT_CHUNK_SECTION = "texto"

# --- fixed values: chunk label "Parte {i}/{n} - Sección: {s}[ (Parte {p})]"
CHUNK_LABEL_PART = "Parte "
CHUNK_LABEL_SECTION = " - Sección: "
CHUNK_LABEL_SUBPART = " (Parte "

# --- fixed values: prompt truncation ---------------------------------------
PROMPT_SEPARATOR = "-----"
TRUNCATION_MARKER = "... [texto truncado]"
PROMPT_CHAR_LIMIT = 26000

# --- fixed values: analysis keys -------------------------------------------
KEY_NAME = "nombre"
KEY_SUMMARY = "resumen"
KEY_RESULTS = "resultados"
KEY_SUCCESS = "exito"
KEY_PERFORMANCE = "performance"
KEY_ERROR = "error"
KNOWN_KEYS = (KEY_SUMMARY, KEY_RESULTS, KEY_NAME, KEY_SUCCESS, KEY_PERFORMANCE)
METADATA_KEY = "__metadata__"

# --- fixed values: fallback record (answer is not JSON) --------------------
FALLBACK_NOT_AVAILABLE = "No disponible (error de formato)"

# --- fixed values: error record (answer unusable) --------------------------
ERROR_PREFIX = "Error al procesar la respuesta: "
ERROR_SUMMARY = "No disponible debido a un error"
ERROR_RESULTS = "No disponible debido a un error"
ERROR_PERFORMANCE = "No disponible"
ERROR_NONE_CONTENT = "argument of type 'NoneType' is not iterable"
ERROR_LIST = "list indices must be integers or slices, not str"
ERROR_STR_ASSIGN = "'str' object does not support item assignment"
ERROR_STR_INDEX = "string indices must be integers, not 'str'"
ERROR_NOT_ITERABLE = "argument of type '{}' is not iterable"

# --- fixed values: consolidation blocks ------------------------------------
CONSOLIDATION_PART = "PARTE "
CONSOLIDATION_SUMMARY = "Resumen: "
CONSOLIDATION_RESULTS = "Resultados: "
NOT_AVAILABLE = "No disponible"

# --- fixed values: merge of partial results --------------------------------
MERGE_JOIN = "\n\n"

# --- fixed values: run summary ---------------------------------------------
SUMMARY_EMPTY = "No se procesaron archivos."
SUMMARY_DONE = "Procesamiento completado."
SUMMARY_TOTAL = "Total procesados: "
SUMMARY_OK = "Exitosos: "
SUMMARY_ERR = "Con errores: "
SUMMARY_OK_HEAD = "Papers procesados exitosamente:"
SUMMARY_ERR_HEAD = "Papers con errores:"
SUMMARY_UNKNOWN_NAME = "Desconocido"
SUMMARY_UNKNOWN_ERROR = "Error desconocido"
PAPER_ERROR_PREFIX = "Error: "

# --- fixed values: readable report -----------------------------------------
REPORT_TITLE = "ANÁLISIS DEL PAPER: "
REPORT_RULE = "=" * 54
REPORT_SUMMARY = "RESUMEN:"
REPORT_RESULTS = "PRINCIPALES RESULTADOS:"
REPORT_SUCCESS = "ÉXITO DEL PAPER: "
REPORT_PERFORMANCE = "MÉTRICAS DE RENDIMIENTO:"
REPORT_YES = "Sí"
REPORT_NO = "No"
REPORT_UNDETERMINED = "No determinado"
REPORT_DEFAULT_TITLE = "Paper sin título"
REPORT_DEFAULT_SUMMARY = "No hay resumen disponible"
REPORT_DEFAULT_RESULTS = "No hay resultados disponibles"
REPORT_DEFAULT_PERFORMANCE = "No especificado"

# --- fixed values: run status ------------------------------------------------
STATUS_SUCCESS = "success"
STATUS_ERROR = "error"

# --- fixed values: chat request ---------------------------------------------
DEFAULT_MODEL = "gpt-4"
DEFAULT_TEMPERATURE = 0.2
DEFAULT_MAX_TOKENS = 1000
ANSWER_TOKEN_CAP = 1000
MAX_ATTEMPTS = 3
RETRY_DELAY = 5.0

# --- fixed values: chunking --------------------------------------------------
CHARS_PER_TOKEN = 4
DEFAULT_CHUNK_SIZE = 6000
MAX_OVERLAP = 500
