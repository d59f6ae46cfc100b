"""Reference value lists.

FIXED VALUES: every list below must equal the source product's lists for the
features to come out the same.  They are written plainly, in their original
order, and must not be edited, reordered or re-encoded.
"""

from __future__ import annotations

# --- FIXED VALUES (begin) ---------------------------------------------------

# Brands compared with the registered-domain label (87 entries).
KNOWN_BRANDS = [
    "google", "gmail", "youtube", "android", "microsoft", "outlook", "office365",
    "onedrive", "skype", "github", "apple", "icloud", "itunes", "facebook",
    "instagram", "whatsapp", "twitter", "x", "linkedin", "snapchat", "tiktok",
    "reddit", "discord", "telegram", "pinterest", "amazon", "flipkart", "ebay",
    "walmart", "shopify", "etsy", "aliexpress", "paypal", "paytm", "phonepe",
    "gpay", "googlepay", "razorpay", "stripe", "visa", "mastercard",
    "americanexpress", "sbi", "hdfc", "icici", "axis", "kotak", "pnb", "bob",
    "canara", "unionbank", "indusind", "yesbank", "idfc", "uidai", "epfo", "gov",
    "income_tax", "gst", "digilocker", "npci", "irctc", "netflix", "primevideo",
    "disney", "hotstar", "spotify", "aws", "azure", "gcp", "dropbox", "zoom",
    "slack", "jio", "airtel", "vi", "bsnl", "swiggy", "zomato", "ola", "uber",
    "makemytrip", "goibibo", "booking", "binance", "coinbase", "wazirx",
]

# Official registered domains (85 entries); a match overrides the model.
KNOWN_ROOTS = [
    "google.com", "gmail.com", "youtube.com", "microsoft.com", "outlook.com",
    "office.com", "live.com", "onedrive.com", "github.com", "apple.com",
    "icloud.com", "facebook.com", "instagram.com", "whatsapp.com", "x.com",
    "twitter.com", "linkedin.com", "snapchat.com", "tiktok.com", "reddit.com",
    "discord.com", "telegram.org", "pinterest.com", "amazon.com", "amazon.in",
    "flipkart.com", "ebay.com", "walmart.com", "shopify.com", "etsy.com",
    "aliexpress.com", "paypal.com", "paytm.com", "phonepe.com", "googlepay.com",
    "razorpay.com", "stripe.com", "visa.com", "mastercard.com",
    "americanexpress.com", "sbi.co.in", "onlinesbi.sbi", "hdfcbank.com",
    "icicibank.com", "axisbank.com", "kotak.com", "pnbindia.in",
    "bankofbaroda.in", "canarabank.com", "unionbankofindia.co.in",
    "indusind.com", "yesbank.in", "idfcfirstbank.com", "uidai.gov.in",
    "epfindia.gov.in", "incometax.gov.in", "gst.gov.in", "digilocker.gov.in",
    "npci.org.in", "irctc.co.in", "netflix.com", "primevideo.com",
    "disneyplus.com", "hotstar.com", "spotify.com", "aws.amazon.com",
    "azure.microsoft.com", "cloud.google.com", "dropbox.com", "zoom.us",
    "slack.com", "jio.com", "airtel.in", "myvi.in", "bsnl.co.in", "swiggy.com",
    "zomato.com", "olacabs.com", "uber.com", "makemytrip.com", "goibibo.com",
    "booking.com", "binance.com", "coinbase.com", "wazirx.com",
]

# Keyword list; "banking" is listed but no feature uses it.
KEYWORDS = [
    "login", "secure", "verify", "account", "update", "signin", "support",
    "banking", "payment",
]

# Keywords that become has_<keyword> features, in feature order.
FEATURE_KEYWORDS = [
    "login", "secure", "verify", "account", "update", "signin", "support",
    "payment",
]

COMMON_TLDS = ["com", "org", "net", "edu", "gov", "mil", "int"]

COUNTRY_CODE_TLDS = [
    "in", "us", "uk", "au", "ca", "de", "fr", "jp", "cn", "sg", "ae", "ru",
    "br", "it", "es", "nl", "ch", "se", "no", "fi", "za", "kr",
]

HIGH_RISK_TLDS = [
    "xyz", "top", "click", "work", "gq", "ml", "cf", "tk", "ga", "pw", "buzz",
    "cam", "cyou", "icu", "monster", "rest", "fit", "accountant", "science",
    "support", "review", "country", "kim", "party", "trade", "stream",
    "download", "racing", "win", "loan", "men", "date", "faith", "cricket",
    "zip", "mov",
]

# Notebook variants.
NOTEBOOK_BRANDS = [
    "google", "facebook", "amazon", "paypal", "microsoft", "apple", "instagram",
    "netflix", "linkedin", "twitter", "sbi", "hdfc", "icici", "axis", "uidai",
    "epfo",
]
# The second feature set's brands; its TLD lists are the app's.
NOTEBOOK_BRANDS_2 = [
    "google", "facebook", "amazon", "paypal", "microsoft", "apple", "instagram",
    "netflix", "linkedin", "twitter", "sbi", "hdfc", "icici", "axis", "uidai",
    "epfo", "gov",
]
NOTEBOOK_ROOTS = [
    "google.com", "facebook.com", "amazon.com", "paypal.com", "microsoft.com",
    "apple.com", "instagram.com",
]
NOTEBOOK_COMMON_TLDS = ["com", "org", "net", "gov", "edu"]
NOTEBOOK_SUSPICIOUS_TLDS = ["xyz", "top", "cc", "cam", "cyou", "shop"]

# Model input columns, in the trained order (23).
FEATURE_ORDER = [
    "is_suspicious_tld", "brand_match", "length", "subdomain_count",
    "special_char_count", "min_brand_distance", "hyphen_count", "digit_count",
    "entropy", "has_login", "has_secure", "has_verify", "has_account",
    "has_update", "has_signin", "has_support", "has_payment",
    "known_brand_root", "has_punycode", "contains_unicode", "unicode_ratio",
    "is_country_code_tld", "is_common_tld",
]

# Curated rows appended (x500) to every training set.
CURATED_LEGITIMATE = [
    "linkedin.com", "www.linkedin.com", "tiktok.com", "www.tiktok.com",
    "tiktokshop.com", "partner.tiktokshop.com", "turtleneckai.netlify.app",
    "saurabh-portfolio.vercel.app", "my-cool-project.onrender.com",
    "react-dashboard-demo.github.io",
]
CURATED_PHISHING = [
    "secure-paypal-login.netlify.app", "apple-verify-account.vercel.app",
    "amazon-support-help.onrender.com", "microsoft-auth-portal.github.io",
]
CURATED_COPIES = 500

# Notebook: known legitimate subdomains added to the combined set (22).
NOTEBOOK_SUBDOMAINS = [
    "mail.google.com", "drive.google.com", "accounts.google.com",
    "docs.google.com", "maps.google.com", "login.microsoftonline.com",
    "outlook.office365.com", "portal.office.com", "aws.amazon.com",
    "console.aws.amazon.com", "business.facebook.com",
    "developers.facebook.com", "support.apple.com", "id.apple.com",
    "mail.yahoo.com", "finance.yahoo.com", "login.live.com",
    "account.live.com", "mail.proton.me", "calendar.google.com",
    "web.whatsapp.com", "business.whatsapp.com",
]

# Class labels; alphabetical order is the encoded order (legitimate=0).
LEGITIMATE = "legitimate"
PHISHING = "phishing"
LABELS = [LEGITIMATE, PHISHING]

# Head of the ranked popularity list kept as legitimate.
RANKED_HEAD_APP = 20000
RANKED_HEAD_NOTEBOOK = 36000

# Distance reported when the brand list is empty.
EMPTY_BRAND_DISTANCE = 99

# Sample-weight bumps (notebook): base 1.0, +99 per flag.
WEIGHT_BASE = 1.0
WEIGHT_BUMP = 99.0

# Boosted-tree settings of the app (300 trees, depth 6, lr 0.05,
# row subsample 0.8, column subsample 0.5 per tree x 0.5 per level).
APP_TREES = 300
APP_DEPTH = 6
APP_STEP = 0.05
APP_SUBSAMPLE = 0.8
APP_FEATURE_FRACTION = 0.25
# Notebook settings (500 trees, lr 0.03, column subsample 0.8, min child 3).
NOTEBOOK_TREES = 500
NOTEBOOK_STEP = 0.03
NOTEBOOK_FEATURE_FRACTION = 0.8
NOTEBOOK_MIN_CHILD = 3
NOTEBOOK_FEATURES = ["is_suspicious_tld", "brand_match", "length"]

# Literals and patterns of the host rules.
HTTP_PREFIX_RE = r"^https?://"
WWW = "www."
PUNYCODE_PREFIX = "xn--"
CYRILLIC_FIRST, CYRILLIC_LAST = 0x0400, 0x04FF
CLIENT_IPV4_OCTET_RE = "(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
MIN_TLD_LENGTH = 2

# File names the dataset resolver looks for (in the folder or its data/).
FEED_TEXT_FILE = "openphish.txt"
FEED_CSV_FILE = "openphish.csv"
FEED_CSV2_FILE = "verified_online.csv"
RANKED_FILE = "top-1m.csv"
COMBINED_FILE = "combined_domains.csv"

# Default history size.
HISTORY_LIMIT = 50
TOP_TLDS = 5

# --- FIXED VALUES (end) -----------------------------------------------------
