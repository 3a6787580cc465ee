"""Rules and packs over the vocabulary of the test documents, one rule per kind of matching."""

SEED_RULES = [
    {"rule_id": "SEED-01", "terms": ["thing", "erin"], "operators": ["AND"], "l1": "Billing", "l2": "Charges",
     "l3": "Overcharge", "l4": "Card", "sentiment": "negative"},
    {"rule_id": "SEED-02", "terms": ["ertion", "attion"], "operators": ["OR"], "l1": "Billing", "l2": "Refund",
     "l3": "Late refund", "sentiment": "negative"},
    {"rule_id": "SEED-03", "terms": ["thble", "thed"], "operators": ["NOT"], "l1": "Technical", "l2": "Crash",
     "sentiment": "negative"},
    {"rule_id": "SEED-04", "terms": ["eron", "of the"], "operators": ["NOT LIKE"], "l1": "Technical", "l2": "Login",
     "l3": "Password", "l4": "Reset"},
    {"rule_id": "SEED-05", "terms": ["thre", "the"], "operators": ["NEAR"], "proximity": 2, "l1": "Service",
     "l2": "Agent", "l3": "Rude", "sentiment": "negative"},
    {"rule_id": "SEED-06", "terms": ["erin", "and"], "operators": ["NEAR"], "proximity": 8, "l1": "Service",
     "l2": "Waiting", "sentiment": "neutral"},
    {"rule_id": "SEED-07", "terms": ["thanea*"], "l1": "Product", "l2": "Quality", "l3": "Defect", "l4": "Broken"},
    {"rule_id": "SEED-08", "terms": ["to thanedble"], "l1": "Product", "l2": "Delivery", "l3": "Late",
     "sentiment": "negative"},
    {"rule_id": "SEED-09", "terms": ["ly"], "l1": "Feedback", "l2": "Praise", "sentiment": "positive"},
    {"rule_id": "SEED-10", "terms": ["thes"], "position": "START", "within_words": 20, "l1": "Feedback",
     "l2": "Idea"},
    {"rule_id": "SEED-11", "terms": ["than"], "position": "END", "within_words": 20, "l1": "Feedback", "l2": "Idea",
     "l3": "Feature"},
    {"rule_id": "SEED-12", "terms": ["anin"], "exclude_if": ["thon"], "l1": "Account", "l2": "Closing"},
    {"rule_id": "SEED-13", "terms": ["thor", "thea", "thti"], "operators": ["AND", "NOT"], "l1": "Account",
     "l2": "Profile", "l3": "Name", "l4": "Change"},
    {"rule_id": "SEED-14", "terms": ["de la"], "l1": "International", "l2": "French", "sentiment": "neutral"},
    {"rule_id": "SEED-15", "terms": ["nicht", "der die"], "operators": ["OR"], "l1": "International", "l2": "German"},
    {"rule_id": "SEED-16", "terms": ["erth*", "ering", "shtion"], "operators": ["OR", "AND"], "l1": "Technical",
     "l2": "Crash", "l3": "Start", "l4": "Update"},
]

SPEAKER_RULES = [
    {"rule_id": "SPK-01", "terms": ["the"], "sent_by": "Customer", "l1": "Customer English"},
    {"rule_id": "SPK-02", "terms": ["der"], "sent_by": "Agent", "l1": "Agent German"},
    {"rule_id": "SPK-03", "terms": ["le"], "sent_by": "any", "l1": "French"},
]

# Pack groups: rules and keyword groups, several conditions each.
SEED_GROUPS = [
    {"kind": "rules", "group_no": 0, "conditions": ["thing", "of the", "erin"], "l1": "Billing", "l2": "Charges",
     "l3": "Overcharge", "l4": "Card", "sentiment": "negative"},
    {"kind": "rules", "group_no": 1, "conditions": ["attion", "to thanedble"], "l1": "Product", "l2": "Delivery",
     "l3": "Late", "l4": "NA", "sentiment": "negative"},
    {"kind": "rules", "group_no": 2, "conditions": ["ertion", "eriner thanea", "thwh"], "l1": "Technical",
     "l2": "Login", "l3": "NA", "l4": "NA", "sentiment": "neutral"},
    {"kind": "rules", "group_no": 3, "conditions": ["de la", "dans"], "l1": "International", "l2": "French",
     "l3": "NA", "l4": "NA", "sentiment": "neutral"},
    {"kind": "keywords", "group_no": 0, "conditions": ["thanedble"], "l1": "Product", "l2": "Quality",
     "l3": "Defect", "l4": "Broken", "sentiment": "negative"},
    {"kind": "keywords", "group_no": 1, "conditions": ["der die", "nicht"], "l1": "International", "l2": "German",
     "l3": "NA", "l4": "NA", "sentiment": "neutral"},
]

# A pack of the usual size: groups by the beginning of a word, with the word itself, as a prefix and in phrases.
PACK_GROUPS = [{"conditions": [w for tail in ("re", "ed", "ble", "on", "tion", "in", "ea", "ing", "or", "al")
                               for w in (head + tail, f"{head}{tail}*", f"{head}{tail} the", f"the {head}{tail}")],
                "set": {"category": "Pack", "subcategory": head, "sentiment": "neutral"}}
               for head in ("th", "er", "sh", "at", "an", "on", "in", "tr")]
PACK_RULES = [{"rule_id": f"DEM-{no:04d}", "terms": [c], "l1": "Pack", "l2": g["set"]["subcategory"],
               "sentiment": "neutral"}
              for no, (g, c) in enumerate(((g, c) for g in PACK_GROUPS for c in g["conditions"]), 1)]
