"""Domain constants.

FIXED VALUES — these must equal the reference's business rules exactly
(status ids, project ids, status names, JSON keys, patterns). They are stated
here once, in natural order; every operator reads them from this module.
"""

from __future__ import annotations

import datetime as _dt

# ---------------------------------------------------------------- FIXED VALUES
# test status ids
STATUS_PASSED = 1
STATUS_BLOCKED = 2
STATUS_UNTESTED = 3
STATUS_RETEST = 4
STATUS_FAILED = 5
STATUS_IN_PROCESS = 6

# special projects
MART_UAT_PROJECT = 12
MART_AUTOMATION_PROJECT = 8
FACT_GENERAL_PROJECT = 17
FACT_UAT_PROJECT = 23
VALIDATION_GENERAL_PROJECT = 17
VALIDATION_UAT_PROJECT = 12

# project exclusion lists
MART_EXCLUDED_PROJECTS = (1, 3, 7, 8, 9, 12, 17, 18, 19, 21, 23)
SUMMARY_EXCLUDED_PROJECTS = (1, 3, 7, 9, 17, 18, 19, 21, 23)
LAST_CYCLE_EXCLUDED_PROJECTS = (12, 21, 7)
LEGACY_KPI_EXCLUDED_PROJECTS = (12, 21)
SYNCED_TEST_PROJECTS = (12, 23, 4, 8)

# tracker statuses and priorities
CLOSED_DEFECT_STATUSES = ("Terminado", "Cerrado", "Cancelado", "Mitigado")
READY_DEFECT_STATUSES = ("Listo para Probar",)
IN_PROGRESS_DEFECT_STATUSES = ("Desarrollo", "Probando", "Analisis", "En Diseño")
OPEN_DEFECT_STATUSES = ("Backlog", "Esperando Aprobación")
AGING_CLOSED_STATUSES = ("Done", "Closed", "Resolved")
SEVERITY_CRITICAL = "Crítica"
SEVERITY_HIGH = "Alta"
SEVERITY_MEDIUM = "Media"
SEVERITY_LOW = "Baja"

# chart dimensions (browser-side groupings)
SEVERITY_LABELS = (("Crítica", "Critico"), ("Alta", "Alto"), ("Media", "Medio"), ("Baja", "Bajo"))
STATUS_GROUP_OPEN = "Abierto"
STATUS_GROUP_IN_PROGRESS = "En Progreso"
STATUS_GROUP_READY = "Listo"
STATUS_GROUP_CLOSED = "Cerrado"
STATUS_GROUP_ORDER = ("Abierto", "En Progreso", "Listo", "Cerrado")
STATUS_GROUPS = (
    ("Backlog", "Abierto"),
    ("Esperando Aprobación", "Abierto"),
    ("Desarrollo", "En Progreso"),
    ("Probando", "En Progreso"),
    ("Analisis", "En Progreso"),
    ("En Diseño", "En Progreso"),
    ("Listo para Probar", "Listo"),
    ("Terminado", "Cerrado"),
    ("Cerrado", "Cerrado"),
    ("Cancelado", "Cerrado"),
    ("Mitigado", "Cerrado"),
)

# dashboard labels: status breakdown (display order) and status pie slices
BREAKDOWN_LABELS = ("Exitosos", "Fallidos", "Devueltos", "Bloqueados", "En Proceso", "Sin Probar")
PIE_LABELS = ("Exitosos", "Fallidos", "Bloqueados", "Devueltos", "Sin Probar")

# data-quality check names
DQ_DUPLICATE_RUNS = "Duplicate Runs"
DQ_FUTURE_DATES = "Future Creation Dates"
DQ_NEGATIVE_COUNTS = "Negative Counts"
DQ_START_AFTER_END = "Start > End"

# case priorities
PRIORITY_CRITICAL = 4
PRIORITY_HIGH = 3
PRIORITY_MEDIUM = 2
PRIORITY_LOW = 1

# cycle rules
PLANNED_CYCLE_DAYS = 14
UAT_PASS_THRESHOLD = 0.95

# JSON keys inside custom_fields
START_DATE_KEYS = ("custom_fecha_de_inicio", "custom_fechainicio")
DUE_DATE_KEYS = ("custom_fecha_de_finalizacion", "custom_fechafinal")
PLAN_CERTIFICATE_KEYS = ("custom_acta_de_certificacin", "custom_acta_certificacion")
RESULT_CERTIFICATE_KEY = "custom_result_acta_certificacion"
ITERATION_KEY = "custom_reincidencia"
CUSTOM_FIELD_PREFIX = "custom_"

# defect key pattern and its cheap prefilter
DEFECT_KEY_PATTERN = r"(CM-\d+)"
DEFECT_KEY_PREFIX = "CM-"

# labels
CERTIFIED_LABEL = "Certificada"
IN_PROCESS_LABEL = "En Proceso"
AUTOMATED_LABEL = "Automatizado"
MANUAL_LABEL = "Manual"
UNASSIGNED_LABEL = "Unassigned"
ANALYST_FALLBACK_PREFIX = "Analista #"
LIST_SEPARATOR = ", "
SOURCE_TAG = "testrail"

# serving limits that are part of the feature
RELATION_HEAD_ROWS = 1000
AGING_TOP_K = 5
UNLINKED_PREVIEW_ROWS = 50
VELOCITY_WINDOW_DAYS = 30
# ------------------------------------------------------------ END FIXED VALUES

# "now" of every operator; fixed for the fixtures so results are reproducible.
DEFAULT_AS_OF = _dt.datetime(2024, 2, 10, 0, 0, 0)
