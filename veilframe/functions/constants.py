"""Values that results depend on."""

# Fixed values.
PLACEHOLDER = "[Privacy Information]"
HASH_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"
CHUNK_CHARS = 500
DETECTION_THRESHOLD = 0.5
FUZZY_THRESHOLD = 0.8
LEAK_THRESHOLD = 0.6

# Detectors in their order.
DETECTORS = (
    ("PHONE_NUMBER", r"\b(?:\+?\d[\d\s\-]{7,}\d)\b"),
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("CREDIT_CARD", r"\b(?:\d[ -]*?){13,16}\b"),
)

# Labels of a zero-shot detector.
MODEL_LABELS = (
    "name", "first name", "last name", "name medical professional", "person name", "dob", "age", "gender", "marital status",
    "email", "email address", "phone number", "ip address", "url", "address", "location address", "location street",
    "location city", "location state", "location country", "location zip",
    "account number", "bank account", "routing number", "credit card", "credit card expiration", "cvv", "ssn", "money",
    "condition", "medical process", "drug", "dose", "blood type", "injury", "organization medical facility",
    "healthcare number", "medical code", "passport number", "driver license", "username", "password", "vehicle id",
)

# Markup words that are never masked.
EXEMPT_WORDS = (
    "[", "]", ";", ":", "#", "bounds", ";;", "url#",
    "TextView", "Button", "ImageButton", "ImageView", "Layout", "LinearLayout", "RelativeLayout", "FrameLayout", "ViewGroup", "View",
    "RecyclerView", "ScrollView", "EditText", "CheckBox", "RadioButton",
    "click", "clickable", "focusable", "selected", "checked", "enabled", "scrollable", "long-clickable", "password", "focused", "checkable",
    "NAF", "index", "text", "resource-id", "class", "package", "content-desc",
    "android.widget", "android.view", "androidx", "The current screenshot's description is shown",
)

# Markup structures, matched without regard to case.
EXEMPT_PATTERNS = (
    r"\[[^\]]+\]",
    r"url#[^\s;]+",
    r";\s*(click|selected|focusable|checked|enabled|scrollable|long-clickable|password|focused|checkable)\s*;",
    r";;",
    r"bounds:\s*\[[^\]]+\]\[[^\]]+\]",
    r"\b(TextView|Button|ImageButton|ImageView|Layout|LinearLayout|RelativeLayout|FrameLayout|ViewGroup|View|RecyclerView|ScrollView|EditText|CheckBox|RadioButton)\b",
    r"android\.(widget|view)",
)

# The rule judge's words.
ACTION_PREFIXES = ("tap", "click", "press", "select", "choose", "open", "hit", "add", "create", "go", "go to")
ACTION_SUFFIXES = ("button", "icon", "option", "tab")
STOP_WORDS = ("the", "to", "a", "an", "and", "or", "of", "on", "in", "at", "new", "your")

# Tokens in masked text.
TOKEN_PATTERN = r"\[?([A-Z_]+#[A-Za-z0-9]+)\]?"

# Fields that a question without a field list asks for.
DEFAULT_FIELDS = ("name", "emailAddress", "username", "address", "phonenumber", "Xiaohongshu ID", "nationality", "Weixin ID")

# Fixed values of trace evaluation.
REPEAT_LIMIT = 7  # the seventh equal step in a row ends a trace
AUTOSTOP_STEPS, AUTOSTOP_EQUAL = 6, 5
TOTAL_TASKS = 138
TAIL_IMAGES = 8
NO_OP_SHARE = 0.999
TRAIN_SHARE = 0.8
