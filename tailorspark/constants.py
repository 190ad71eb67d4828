"""Fixed values that must equal the reference behaviour for right results.

Everything in this module is a fixed value (names, thresholds, texts, level
order).  They are stated plainly and in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: feature and context columns
# ---------------------------------------------------------------------------
NUMERIC_FEATURE_COLS = ["total_events", "unique_pages", "total_revenue", "days_since_first_visit"]
CONTEXT_COLS = ["category", "region", "country", "source", "medium", "Age"]
LOG_TRANSFORM_COLS = ["total_events", "unique_pages", "total_revenue"]
UNKNOWN = "unknown"
DAYS_WHEN_UNKNOWN = 365

# ---------------------------------------------------------------------------
# FIXED VALUES: personas (order defines dense ids) and business tags
# ---------------------------------------------------------------------------
PERSONA_ORDER = ["repeat_purchaser", "one_time_buyer", "cart_abandoner", "browser", "cold_user"]
HIGH_INTENT_EVENTS = 5
TAG_HIGH_VALUE = "high_value"
TAG_NEW_USER = "new_user"
TAG_FREQUENT = "frequent_shopper"
TAG_STANDARD = "standard"
TAG_HIGH_VALUE_SEGMENT = "high_value_segment"
HIGH_VALUE_REVENUE = 200.0
NEW_USER_DAYS = 30
FREQUENT_EVENTS = 50

# ---------------------------------------------------------------------------
# FIXED VALUES: routing and cascade
# ---------------------------------------------------------------------------
MIN_EVENTS_FOR_BEHAVIORAL = 3
RF_THRESHOLD = 0.65
SEQUENCE_THRESHOLD = 0.90
COLD_CONFIDENCE = 0.5
SEQUENCE_MAX_LEN = 25
SOURCE_DEEP = "deep_model"
SOURCE_FOREST = "random_forest_fallback"
SOURCE_SEQUENCE = "lstm_override"
SOURCE_GLOBAL = "cold_start_global_default"
SOURCE_LOOKUP_PREFIX = "cold_start_lookup:"
SEED = 42

# ---------------------------------------------------------------------------
# FIXED VALUES: cold-start backoff levels, most to least specific
# ---------------------------------------------------------------------------
BACKOFF_LEVELS = [
    ("region", "category", "source"),
    ("region", "category"),
    ("region", "source"),
    ("category", "source"),
    ("source", "medium"),
    ("region",),
    ("category",),
    ("source",),
    ("medium",),
    (),
]
BACKOFF_KEYS = ["region", "category", "source", "medium"]
MIN_SUPPORT_FLOOR = 10
MIN_SUPPORT_FRACTION = 0.0005
GLOBAL_TOP_CATEGORY = "Featured Products"
GLOBAL_CLUSTER = 0

# ---------------------------------------------------------------------------
# FIXED VALUES: catalog and page texts
# ---------------------------------------------------------------------------
UNKNOWN_CATEGORY = "Unknown"
CLIENT_UNKNOWN_CATEGORY = "UNKNOWN_CATEGORY"
RECENCY_WINDOW = 8
RECENCY_BASE = 2.0
PRODUCTS_PER_MODULE = 4
RECENT_EVENTS_MAX = 20
HERO_TITLE_FORMAT = "Explore Our %s Collection"
HERO_SUBTITLE = "Find exactly what you need from our handpicked selection."
HERO_CTA = "Shop Now"
MODULE_PRIMARY_FORMAT = "Top Picks in %s"
MODULE_SECONDARY_FORMAT = "Trending in %s"
# (type, title, button_text) in first-match order
CTA_LOYALTY = ("loyalty", "An Exclusive Offer for Our VIPs", "View Your Deals")
CTA_FIRST_PURCHASE = ("first_purchase", "Get 20% Off Your First Order!", "Claim Offer")
CTA_ENGAGEMENT = ("engagement", "Explore Our Best-Sellers", "See What's Popular")
CTA_STANDARD = ("standard", "Discover Something New", "Browse All")
CTA_ENGAGEMENT_BELOW = 100.0

# Normalised-response defaults (client side)
DEFAULT_HERO = ("Welcome to UltraPersonal.", "Discover curated products tailored to your behavior.", "Start Exploring")
DEFAULT_DETAILS_TAGS = ["fallback_mode"]

# ---------------------------------------------------------------------------
# FIXED VALUES: request defaults and device guess
# ---------------------------------------------------------------------------
REQUEST_DEFAULT_EVENTS = 1
REQUEST_DEFAULT_PAGES = 1
REQUEST_DEFAULT_REVENUE = 0.0
REQUEST_DEFAULT_DAYS = 0
DEVICE_TABLET_MARKERS = ["tablet", "ipad"]
DEVICE_MOBILE_MARKERS = ["mobi", "android", "iphone"]

# ---------------------------------------------------------------------------
# FIXED VALUES: catalog bootstrap from an image listing
# ---------------------------------------------------------------------------
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".gif"]
SLUG_EMPTY = "ITEM"
BOOTSTRAP_PLACEHOLDERS = {
    "name": "TODO: product name",
    "brand": "TODO: brand",
    "category": "TODO: Apparel | Shoes | Accessories | Furniture | Office Gear",
    "display_category": "TODO: subcategory (e.g. Bottomwear, Sneakers)",
    "price": 0.0,
    "original_price": 0.0,
    "discount": 0.0,
    "rating": "4.0",
    "description": "TODO: short description",
}
IMAGE_URL_PREFIX = "/images/"

# ---------------------------------------------------------------------------
# FIXED VALUES: model settings
# ---------------------------------------------------------------------------
FOREST_TREES = 200
FOREST_DEPTH = 12
MLP_HIDDEN = [128, 64]
KMEANS_MAX_K = 6
KMEANS_STARTS, KMEANS_FINAL_STARTS = 3, 5
SMALL_CLUSTER_FRACTION = 0.01
SMALL_CLUSTER_ABS = 20
VALIDATION_FRACTION = 0.2
EVAL_SAMPLE_SIZE = 500
TRAIN_MIN_USERS = 30
SEQUENCE_MIN_ROWS = 20
