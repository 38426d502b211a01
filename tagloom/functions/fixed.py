"""Word lists, lookup tables, thresholds and presets.

These must keep exactly these values for results to be right; everything here
is a default that callers may replace by an argument.
"""

# A URL is refused when its authority contains one of these.
BLOCKED_HOST_TERMS = (
    "xhcdn", "xhamster", "pornhub", "phncdn", "xvideos", "xnxx", "redtube",
    "rule34", "e621", "e-hentai", "hentai", "nhentai", "gelbooru", "danbooru",
    "sankaku", "porn", "nsfw", "adult", "xxx", "redgifs", "imagefap",
)

# Image extensions that are kept, and the one used otherwise.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
DEFAULT_EXTENSION = ".jpg"

# Slugs whose display name does not follow the general rule.
DISPLAY_SPECIAL = {
    "nidoran-f": "Nidoran-F",
    "nidoran-m": "Nidoran-M",
    "mr-mime": "Mr. Mime",
    "farfetchd": "Farfetch'd",
    "ho-oh": "Ho-Oh",
    "mime-jr": "Mime Jr.",
    "deoxys-normal": "Deoxys",
}

# Lower-case names whose slug does not follow the general rule.
SLUG_OVERRIDES = {
    "farfetch'd": "farfetchd",
    "farfetchd": "farfetchd",
    "mr. mime": "mr-mime",
    "mrmime": "mr-mime",
    "mime": "mr-mime",
    "nidoran1": "nidoran-f",
    "nidoran2": "nidoran-m",
    "deoxys": "deoxys-normal",
    "mime jr.": "mime-jr",
}

# Spellings of the older model's classes -> canonical names.
LABEL_ALIASES = {
    "Farfetchd": "Farfetch'd",
    "Mime": "Mr. Mime",
    "MrMime": "Mr. Mime",
    "Nidoran1": "Nidoran-F",
    "Nidoran2": "Nidoran-M",
}

# Search and prompt texts, %s is the class name.
SEARCH_TEMPLATES = (
    "%s pokemon official artwork",
    "%s pokemon video game render",
    "%s pokemon trading card",
    "%s pokemon pencil sketch drawing",
)
SEARCH_ENGINES = ("bing", "ddg")
TARGET_PROMPT = "a picture of %s, a Pokemon"
GENERIC_PROMPTS = (
    "a random photo",
    "text",
    "a screenshot of a website",
    "a different cartoon character",
    "a meme",
)
EXPLICIT_PROMPTS = ("a nude person", "explicit pornography", "a sexual image")
CARD_SUPERTYPE = "Pokémon"

# Thresholds and sizes.
SIMILARITY_SCALE = 100.0
KEEP_THRESHOLD = 0.22
EXPLICIT_THRESHOLD = 0.15
TRUST = 0.55
VERDICT_THRESHOLD = 60.0
CROP_FRACTION = 0.52
HASH_SIZE = 8
PER_CLASS_TARGET = 120
OVERFETCH = 3
VAL_FRACTION = 0.1
TEST_FRACTION = 0.1
PLAIN_TRAIN_FRACTION = 0.8
LABEL_SMOOTHING = 0.1
WEIGHT_DECAY = 0.05
PATIENCE = 6
SEED = 42
BATCH_SIZE = 32
MEMBER_COUNT = 151

# Per-channel (mean, std), RGB order.
IMAGENET_NORM = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
HALF_NORM = ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5))

# File-name prefix -> provenance; other names are "crawler".
PROVENANCE_PREFIXES = {"seed_": "seed", "card_": "card", "ddg_": "ddg"}

# Ranges of the augmentation recipes, bounds included.
SKETCH_STYLES = ("pencil", "edge", "threshold")
TRAIN_SKETCH_P = 0.9
EVAL_SKETCH_P = 1.0
PENCIL_RADIUS = (8.0, 28.0)
PENCIL_ALPHA = (0.35, 0.75)
EDGE_LOW = (40, 100)
EDGE_GAP = (40, 120)
THRESHOLD_BLOCKS = (7, 9, 11, 15, 21)
THRESHOLD_C = (2, 9)
POST_BLUR_P = 0.3
POST_BLUR_RADIUS = (0.5, 1.5)
FIXED_PENCIL_RADIUS = 21.0
FIXED_PENCIL_ALPHA = 0.5
