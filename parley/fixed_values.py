"""Word lists, patterns and labels on which results depend.

Everything here is a constant that must not change if results are to stay
comparable; no logic lives in this module.
"""

# Sentinels of the result table.
UNCATEGORIZED = "Uncategorized"
NOT_AVAILABLE = "NA"

# Speaker labels which may open a transcript line.
AGENT_LABELS = ["agent", "representative", "rep", "support", "advisor", "associate", "consultant"]
CUSTOMER_LABELS = ["customer", "client", "caller", "member", "subscriber", "user", "guest", "visitor"]

# Stop words of the n-gram and collocation reports.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does "
    "did will would should could may might can i you he she it we they my your his her its our their this that "
    "these those"
).split()

# Characters stripped from both ends of a token.
TOKEN_EDGE = ".,!?;:"

# Personal-data patterns of the validated detectors.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONES = [
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    r"\(\d{3}\)\s*\d{3}[-.]?\d{4}",
    r"\+1[-.]?\d{3}[-.]?\d{3}[-.]?\d{4}",
]
CARD = r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"
CARD_BRANDS = [
    r"\b(?:4[0-9]{12}(?:[0-9]{3})?)\b",
    r"\b(?:5[1-5][0-9]{14})\b",
    r"\b(?:3[47][0-9]{13})\b",
    r"\b(?:6(?:011|5[0-9]{2})[0-9]{12})\b",
]
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
DOB = r"\b(?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12][0-9]|3[01])[/-](?:19|20)\d{2}\b"
MRN = r"(?i)\b(?:MRN|Medical Record)[:\s]+([A-Z0-9]{6,12})\b"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
ADDRESS_SUFFIXES = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Apartment|Apt|Suite|Ste|Unit"
ADDRESS = r"(?i)\b\d+\s+[A-Za-z0-9\s,.-]+(?:" + ADDRESS_SUFFIXES + r")\b"
CONDITIONS = [
    "diabetes", "cancer", "hiv", "aids", "covid", "covid-19", "coronavirus", "hypertension", "depression",
    "anxiety", "asthma", "copd", "pneumonia", "tuberculosis", "hepatitis", "alzheimer", "parkinson",
    "schizophrenia", "epilepsy", "stroke", "heart attack", "myocardial infarction",
]

# Personal-data patterns of the hardened redactor, in order of application.
HARDENED = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("CARD", r"\b(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|3[47]\d{13}|6(?:011|5\d{2})\d{12})\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("MRN", r"\b(?:MRN|Medical\s*Record|Patient\s*ID)[:\s#]+[A-Z0-9]{5,12}\b"),
    ("DOB", r"\b(?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}\b"),
    ("IP", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
    ("PHONE", r"(?:\+?1?[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("ADDR", r"\b\d{1,5}\s+[A-Za-z0-9\s,.-]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court"
             r"|Ct|Way|Place|Pl|Circle|Cir|Apt|Suite|Ste|Unit)\b"),
]

# Names of the per-type counters and of the standards named in the compliance report.
PII_COUNTERS = {
    "EMAIL": "emails", "CARD": "credit_cards", "SSN": "ssns", "PHONE": "phones", "DOB": "dobs",
    "MRN": "medical_records", "IP": "ip_addresses", "ADDRESS": "addresses", "CONDITION": "diseases", "NAME": "names",
}
COMPLIANCE_STANDARDS = ["HIPAA", "GDPR", "PCI-DSS", "CCPA"]

# Transcript formats: group 1 is the text of the consumer.
CONSUMER_SIMPLE = r"(?id)Consumer:\s*(.*?)(?=\s*\|\s*\d{4}-\d{2}-\d{2}|$|\s*\|\s*Agent:)"
CONSUMER_SIMPLE_FALLBACK = r"(?id)Consumer:\s*(.*?)(?=\||$)"
CONSUMER_FORMATS = [
    r"(?isd)\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+[+-]\d{4}\s+Consumer:\s*(.*?)(?=\s*\|\s*\d{4}-\d{2}-\d{2}|$)",
    r"(?isd)\[\d{2}:\d{2}:\d{2}\s+(?:CUSTOMER|USER|CLIENT)\]:\s*(.*?)"
    r"(?=\[\d{2}:\d{2}:\d{2}\s+(?:AGENT|SUPPORT|REP)\]|$)",
    r"(?isd)(?:Consumer|Customer|User|Client):\s*(.*?)(?=\s*\|\s*(?:Agent|Support|Representative|Rep):|$)",
    r"(?isd)(?:Consumer|Customer|User|Client):\s*(.*?)(?=\||$)",
]

# Topic keywords (order of topics decides ties).
TOPICS = {
    "login issue": [
        "login", "log in", "sign in", "sign-in", "signin", "sign out", "sign-out", "signout", "password",
        "forgot password", "reset password", "authentication", "verify account", "verification code", "2fa",
        "two-factor", "two factor", "unable to access account", "can't log in", "cannot login",
    ],
    "account issue": [
        "account", "profile", "username", "display name", "linked account", "merge account", "multiple accounts",
        "email change", "update details", "account disabled", "account locked", "deactivate account",
        "delete account",
    ],
    "playback issue": [
        "playback", "stream", "music not playing", "song not playing", "track skipped", "buffering", "lag", "pause",
        "stuck", "stops suddenly", "won't play", "audio issue", "no sound", "silence", "volume problem",
        "audio quality",
    ],
    "device issue": [
        "bluetooth", "speaker", "carplay", "android auto", "smart tv", "echo", "alexa", "chromecast", "airplay",
        "headphones", "device not showing", "device disconnected", "connection issue",
    ],
    "content restriction": [
        "song not available", "track unavailable", "region restriction", "country restriction", "not licensed",
        "greyed out", "removed song", "can't find song", "missing track",
    ],
    "ad issue": [
        "ads", "advertisement", "too many ads", "ad volume", "ad playing", "premium ads", "commercials",
        "ad frequency",
    ],
    "recommendation issue": [
        "recommendations", "discover weekly", "radio", "algorithm", "curated", "autoplay", "song suggestions",
        "not relevant", "bad recommendations",
    ],
    "ui issue": [
        "interface", "layout", "design", "dark mode", "theme", "buttons not working", "search not working",
        "filter not working", "navigation", "menu",
    ],
    "general feedback": [
        "suggestion", "feedback", "recommend", "love spotify", "like app", "app improvement", "feature request",
        "enhancement",
    ],
    "network failure": [
        "network", "connectivity", "internet", "server", "connection failed", "offline", "not connecting",
        "spotify down", "timeout", "dns", "proxy", "vpn",
    ],
    "app crash": [
        "crash", "crashed", "app closed", "stopped working", "freeze", "freezing", "hang", "bug", "error message",
        "glitch", "unresponsive", "not responding",
    ],
    "performance issue": [
        "slow", "lag", "delay", "performance", "loading", "slow loading", "takes forever", "laggy",
    ],
    "data sync issue": [
        "sync", "not syncing", "listening history", "recently played", "activity feed", "spotify connect",
        "data lost", "missing data", "playlist not syncing",
    ],
    "subscription issue": [
        "subscription", "plan", "premium", "cancel", "renew", "billing", "charged", "payment", "refund", "invoice",
        "upgrade", "downgrade", "free trial", "family plan", "student plan", "gift card", "promo code",
        "spotify wrapped", "card", "payment failed",
    ],
}

# Subtopic keywords, inside a topic.
SUBTOPICS = {
    "subscription issue": {
        "payment": ["refund", "charged", "billing", "invoice", "payment", "payment failed", "card declined"],
        "cancel": ["cancel", "unsubscribe", "stop subscription", "end subscription"],
        "upgrade": ["upgrade", "family plan", "student plan", "premium", "switch plan"],
    },
    "account issue": {
        "login": ["login", "password", "signin", "sign in", "authentication"],
        "profile": ["profile", "email", "username", "display name", "account settings"],
    },
    "device issue": {
        "mobile": ["phone", "android", "iphone", "ios", "mobile app"],
        "car": ["carplay", "android auto", "car", "vehicle"],
        "smart_device": ["alexa", "echo", "chromecast", "smart tv", "airplay"],
    },
}

# Words which force a topic.
FORCE_PAYMENT = ["refund", "charged", "billing", "payment failed"]
FORCE_NEGATIVE = ["refund", "charged"]

# Theme keywords; the order of themes is the priority of the primary theme.
THEMES = {
    "Agent_Behavior": [
        "agent", "representative", "rep", "staff", "employee", "behavior", "behaviour", "rude", "unprofessional",
        "helpful", "courteous", "listening", "attitude", "manner", "conduct",
    ],
    "Technical_Issues": [
        "error", "bug", "issue", "problem", "technical", "system", "website", "app", "application", "crash", "down",
        "not working", "broken", "glitch", "malfunction",
    ],
    "Customer_Service": [
        "service", "support", "help", "assist", "assistance", "customer", "experience", "satisfaction", "quality",
        "care",
    ],
    "Communication": [
        "communication", "call", "email", "message", "contact", "reach", "respond", "response", "reply",
        "follow up", "callback",
    ],
    "Billing_Payments": [
        "bill", "billing", "payment", "charge", "charged", "fee", "cost", "invoice", "transaction", "pay", "paid",
        "refund", "overcharge",
    ],
    "Product_Quality": [
        "product", "quality", "defect", "damaged", "broken", "faulty", "poor", "excellent", "good", "bad",
        "condition",
    ],
    "Cancellation_Refund": [
        "cancel", "cancellation", "refund", "return", "exchange", "reimbursement", "money back",
    ],
    "Policy_Terms": [
        "policy", "term", "terms", "condition", "conditions", "rule", "rules", "regulation", "guideline",
    ],
    "Account_Access": [
        "account", "login", "password", "access", "locked", "unlock", "reset", "credentials", "username",
    ],
    "Order_Delivery": [
        "order", "delivery", "shipping", "dispatch", "arrival", "received", "tracking", "delayed", "late", "package",
    ],
    "Booking_Reservation": [
        "booking", "reservation", "appointment", "schedule", "reschedule", "book", "reserved",
    ],
    "Pricing_Cost": [
        "price", "pricing", "cost", "expensive", "cheap", "discount", "offer", "promotion", "deal",
    ],
    "Verification_Auth": [
        "verify", "verification", "confirm", "confirmation", "validation", "authenticate", "authorization",
    ],
}

# Sentiment weights and band limits.
SENTIMENT_WEIGHTS = {"polarity": 0.6, "valence": 0.4}
SENTIMENT_LIMITS = {"very_negative": -0.75, "negative": -0.25, "positive": 0.25, "very_positive": 0.75}

# Column-role hints.
ID_HINTS = ["id", "conversation", "ticket", "case", "record"]
COMPANY_HINTS = ["company", "organization", "org", "business", "client", "customer"]
