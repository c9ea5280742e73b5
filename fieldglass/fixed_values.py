"""Fixed values.

Names, patterns, thresholds and lookup tables that results depend on. They are
stated here once, as plain data, and used by the operators.
"""

# white space as str.split() sees it, and everything that is not a word character
SPACE_CLASS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The characters of ``SPACE_CLASS`` by a property that Java tests in one step; for its patterns alone.
SPACE_PROPERTY = r"(?U)[\s\x1c-\x1f]"
NON_WORD_CLASS = r"[^\p{L}\p{N}_]"
WORD_CLASS = r"[\p{L}\p{N}_]"

# characters whose upper case is more than one character, with their one-to-one upper case (Unicode's simple mapping),
# and the first of the private-use characters that stand for them
SIMPLE_UPPER = {c: "\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0x20000)) if len(c.upper()) > 1}
SHIELD = 0xF0000

# chunking
CHUNK_WORDS = 500
CHUNK_OVERLAP = 50
SECTION_NUMBER = r"(?s)^(\d+(?:\.\d+)*)\s+(.*)$"
NOISE_TERM = r"^\d+$|^.{1,2}$"

# codes
RAN_CODE = r"^A\d{7}R$"
NON_RAN_CODE = r"^[AH]\d{3}D$"
EMBEDDED_FEATURE_ID = r"FGR-[A-Z]{2}\d{4}"
NULL_LIKE = ["none", "null", "n/a", "na"]

# packet log line: optional number, clock or seconds, source, destination, protocol, size
PACKET_LINE = (
    r"^\s*(?:(\d+)\s+)?(\d{1,2}:\d{2}:\d{2}\.\d+|\d+\.\d+)\s+"
    r"(\d{1,3}(?:\.\d{1,3}){3})\s+(\d{1,3}(?:\.\d{1,3}){3})\s+(\S+)\s+(\d+)\b"
)
DAY_SECONDS = 86400
PACKET_COUNTERS = ["captured", "received by filter", "dropped by kernel", "dropped by interface"]

# traffic accounting
PRICE_PER_TOKEN = 1e-7
ACK_TEXT = "(ack)"
CHARS_PER_TOKEN = 4

# protocol markers found in header names or values
PROTOCOL_HINTS = {
    "mcp": "MCP (Model Context Protocol)",
    "a2a": "A2A (Agent2Agent)",
    "jsonrpc": "JSON-RPC",
    "json-rpc": "JSON-RPC",
    "text/event-stream": "SSE (server-sent events)",
    "agent-card": "A2A agent card",
}

# profiling
SIZE_LARGE = 10000
SIZE_MEDIUM = 1000
NORMAL_SKEW = 0.5
NORMAL_KURTOSIS = 2.0
STRONG_CORRELATION = 0.8
OUTLIER_Z = 3.0
REASON_SKEW = 1.0
REASON_OUTLIER_RATIO = 0.05
CURRICULUM_RATIO = 0.5
CONTINUAL_SKEW = 2.0

# retrieval
RRF_K = 60
FIELD_WEIGHTS = {"meta_sparse": 0.4, "contents_dense": 0.3, "contents_sparse": 0.2, "meta_dense": 0.1}
CENTROID_THRESHOLD = 0.65
RULE_THRESHOLD = 0.9
RERANK_THRESHOLD = 0.8
RECALL_AT = [5, 10, 50]
HISTORY_TURNS = 5
BM25_K1 = 1.2
BM25_B = 0.75

# routes and the document types each one searches
ROUTES = [
    "structured_lookup",
    "definition_explain",
    "procedural",
    "diagnostic",
    "comparative",
    "default_rag",
]
ROUTE_DOC_TYPES = {
    "structured_lookup": ["parameter_ref", "counter_ref", "alarm_ref"],
    "definition_explain": ["feature_desc", "spec"],
    "procedural": ["mop", "install_guide"],
    "diagnostic": ["alarm_ref", "feature_desc"],
    "comparative": ["release_notes", "feature_desc"],
    "default_rag": ["feature_desc", "spec", "mop", "install_guide", "release_notes"],
}
UNKNOWN_ROUTE_DOC_TYPES = ["feature_desc"]
ENTITY_DOC_TYPES = {"alarm_code": "alarm_ref", "param_name": "parameter_ref", "mo_name": "parameter_ref"}

# routing rules in order of precedence: name, pattern, route, confidence, entity
ALARM_CODE = r"(?iU)\bALM-(\d+)\b"
ALARM_WORD = r"(?iU)\balarm\s+(\d+)\b"
MO_NAME = r"(?U)\b([A-Z][A-Za-z]{4,}(?:DU|FDD|TDD|Cell|Ran|NR|LTE|SA|NSA))\b"
COUNTER_GROUP = r"(?U)\b([A-Z]-\d{3,5})\b"
COUNTER_NAME = r"(?U)\b([A-Z]{2,8}(?:\.[A-Z][A-Za-z0-9]{1,}){2,})\b"
COMPARATIVE = r"(?U)차이점은|차이는|무엇이 다른가|어떻게 다른가|비교|와\s+\S+의\s+차이|\bvs\b"
PROCEDURAL = (
    r"(?U)절차는|절차가|어떤\s+순서로|어떻게\s+수행|어떻게\s+진행|순서로\s+진행|단계로\s+수행|처리해야\s+하는가"
    r"|수행되는가|진행되는가|어떻게\s+되는가"
)
DIAGNOSTIC = (
    r"(?U)원인은|원인이\s+무엇|원인과\s+확인|점검해야\s+할|점검할\s+|점검해야\s+하는가|안\s+될\s+때|안되는\s+이유"
    r"|이유는\s+무엇|실패.*원인|확인할\s+조건|우선\s+확인|우선\s+점검|어떤\s+요소를|무엇을\s+점검|어떤\s+요인"
    r"|미충족으로|어떤\s+보호\s+요구"
)
NUMERIC_LOOKUP = (
    r"(?U)얼마인가|몇\s+개|기본값은|몇\s*가지인가|몇\s*초|몇\s*ms|식별자는\s+무엇|파라미터는\s+무엇|최대\s+크기는"
    r"|최소\s+크기는|몇\s+개가\s+제시|어느\s+주파수|몇\s+가지"
)
DEFINITION = (
    r"(?U)[는은]\s+무엇인가|[는은]\s+무엇이며|이란\s+무엇|란\s+무엇|무엇을\s+의미|무엇을\s+나타내|[을를]\s+뜻하는가"
    r"|[을를]\s+가리키는가|어떤\s+의미인가|어떤\s+의미로|어떤\s+개념인가|어떤\s+개념으로|어떤\s+역할[을를이]"
    r"|어떤\s+용도로|어떤\s+개념이[며인]|정의는\s+무엇|[을를]\s+뜻하며|[을를]\s+의미하며|약자[이인가는]|약어[이인가는]"
    r"|무엇을\s+위한|무엇을\s+하는|무엇을\s+다루는|[을를이]\s+의미하는가|무엇을\s+식별|무엇을\s+포함|나타내는가"
)
SPEC_REFERENCE = r"(?iU)\b(?:3GPP\s+)?TS\s*(\d{2})[\.\s]?(\d{3})\b"
PARAM_NAME = (
    r"(?U)\b([a-z][a-zA-Z]{3,}(?:Power|Timer|Threshold|Max|Min|Offset|Hysteresis|Period|Level|Limit))\b"
)

# retrieval failure reasons
FAILURE_REASONS = [
    "decomposition_needed",
    "vocabulary_mismatch",
    "ambiguous_query",
    "chunking_issue",
    "multi_index_needed",
]

# header cells of reference sheets, in lower case, and the field each one names
ALARM_HEADERS = {
    "alarm code": "alarm_id",
    "alarm id": "alarm_id",
    "code": "alarm_id",
    "id": "alarm_id",
    "alarm name": "alarm_name",
    "name": "alarm_name",
    "severity": "severity",
    "level": "severity",
    "group": "group",
    "category": "group",
}
ALARM_REQUIRED = ["alarm_id", "alarm_name"]
COUNTER_HEADERS = {
    "대분류": "large_group",
    "large group": "large_group",
    "layer": "large_group",
    "technology group": "large_group",
    "group category": "large_group",
    "tech group": "large_group",
    "중분류": "mid_group",
    "group name": "mid_group",
    "counter group": "mid_group",
    "category": "mid_group",
    "sub group": "mid_group",
    "subgroup": "mid_group",
    "중 그룹명": "mid_group",
    "id": "mid_group_id",
    "group id": "mid_group_id",
    "counter id": "mid_group_id",
    "no": "mid_group_id",
    "중 그룹 id": "mid_group_id",
    "mid group id": "mid_group_id",
    "counter name": "counter_name",
    "name": "counter_name",
    "카운터명": "counter_name",
    "counter": "counter_name",
    "description": "description",
    "desc": "description",
    "설명": "description",
    "period": "period",
    "measurement period": "period",
    "주기": "period",
    "interval": "period",
    "collection period": "period",
    "unit": "unit",
    "단위": "unit",
    "min": "min_val",
    "minimum": "min_val",
    "최솟값": "min_val",
    "min value": "min_val",
    "max": "max_val",
    "maximum": "max_val",
    "최댓값": "max_val",
    "max value": "max_val",
    "value range": "value_range",
    "range": "value_range",
    "값 범위": "value_range",
    "feature id": "feature_id",
    "feature": "feature_id",
    "피처 id": "feature_id",
    "feature_id": "feature_id",
}
COUNTER_REQUIRED = ["counter_name"]
PARAMETER_HEADERS = {
    "hierarchy": "yang_path",
    "yang path": "yang_path",
    "yang": "yang_path",
    "parameter": "param_name",
    "parameter name": "param_name",
    "param name": "param_name",
    "name": "param_name",
    "description": "description",
    "desc": "description",
    "attribute": "attribute",
    "key leaf": "key_leaf",
    "keyleaf": "key_leaf",
    "status": "status",
    "units": "units",
    "unit": "units",
    "type": "type",
    "pattern": "pattern",
    "range": "range",
    "default value": "default",
    "default": "default",
    "bandwidth-dependancy": "bandwidth_dependency",
    "bandwidth dependancy": "bandwidth_dependency",
    "bandwidth dependency": "bandwidth_dependency",
    "config value": "config_value",
    "config_value": "config_value",
    "level": "level",
    "restriction": "restriction",
    "service impact": "service_impact",
    "service_impact": "service_impact",
    "real time change": "realtime_change",
    "real-time change": "realtime_change",
    "reference": "reference",
    "mandatory": "mandatory",
    "parameter-family": "param_family",
    "parameter family": "param_family",
    "related feature id": "related_feature_id",
    "related feature": "related_feature_id",
    "user level": "user_level",
    "userlevel": "user_level",
    "feature name": "feature_name",
    "feature": "feature_name",
    "min": "min",
    "minimum": "min",
    "max": "max",
    "maximum": "max",
}
PARAMETER_REQUIRED = ["param_name", "yang_path"]
HEADER_ROWS = 10

# integer types of schema leaves and their native ranges
INTEGER_RANGES = {
    "int8": (-128, 127),
    "int16": (-32768, 32767),
    "int32": (-2147483648, 2147483647),
    "int64": (-9223372036854775808, 9223372036854775807),
    "uint8": (0, 255),
    "uint16": (0, 65535),
    "uint32": (0, 4294967295),
    "uint64": (0, 18446744073709551615),
}

# state machine extraction
STATE_TOKEN = r"RRC_[A-Z_]+"
CORE_STATES = ["RRC_IDLE", "RRC_CONNECTED", "RRC_INACTIVE"]
STATE_MIN_LENGTH = 6
SENTENCE_BREAK = r"\n|(?<=[a-z0-9])\.\s+"
TRANSITION_VERBS = ["transition", "enter", "move", "resume", "suspend", "leave", "go to"]
CONTEXT_CHARS = 150

# layout
PARAGRAPH_GAP_RATIO = 0.45
PARAGRAPH_GAP_MIN = 4.0
PARAGRAPH_GAP_FALLBACK = 5.0
WATERMARK_ANGLE = 55
WATERMARK_TOLERANCE = 2.5
PAGE_ROTATIONS = [0, 90, 180, 270]
HEADER_RATIO = 0.08
FOOTER_RATIO = 0.08
REPEAT_MIN_CHARS = 4
REPEAT_MAX_CHARS = 120
REPEAT_MIN_ALNUM = 4
REPEAT_MAX_WORDS = 8

# graph vocabulary
NODE_TYPES = ["control_group", "function", "feature", "layer", "kpi", "parameter"]
DEFAULT_RELATION = "RELATED_TO"

# fixed forms of an abbreviations section and its entries
ACRONYM_ENTRY = r"^\s*>?\s*([A-Za-z][A-Za-z0-9_\\\-]{1,19})[ \t]+(.+?)\s*$"
ACRONYM_TITLE = "bbreviations"  # stands in every such section
ACRONYM_SECTION = (
    r"(?sm)(?:^#{1,6}\s+[\d.]*\s*[Aa]bbreviations\s*$|^[\d.]*\s*[Aa]bbreviations\s*\n[-=]{3,}\s*$)"
    r"(.*?)(?=^#{1,6}\s+\S|^\S[^\n]*\n[-=]{3,}\s*$|\z)"
)
