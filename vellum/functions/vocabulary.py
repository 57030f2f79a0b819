"""Closed vocabularies. Fixed values of the data model, in their order."""

OBJECT_CLASSES = ("article", "advertisement", "listing", "classified_section", "legal_notice", "coupon", "masthead", "filler_slug", "manuscript_annotation", "caption", "illustration")

TOPICS = (
    "Local Government & Civic", "Business & Commerce", "Schools & Education", "Churches & Religion", "Clubs & Societies", "Crime & Courts",
    "Obituaries & Deaths", "Real Estate & Building", "Agriculture & Rural Life", "Sports & Recreation", "Health & Medicine", "National & World",
)

NON_PUBLICATION = ("manuscript_annotation", "filler_slug")
CAPTURE_ONLY = ("filler_slug", "manuscript_annotation", "masthead", "illustration", "caption")
STRUCTURED = ("classified_section", "legal_notice")

#: Steps of the service and the part of it that they belong to.
STEP_GROUPS = {
    "group": "ingest", "transcribe": "ingest", "enrich": "ingest", "title": "curation", "reextract": "curation", "summary": "curation",
    "chat": "patron", "edition": "patron", "podcast-script": "patron", "podcast-voice": "patron", "voice-test": "staff",
}

TYPE_ORDER = ("y-article", "y-ad", "y-photo", "y-cartoon", "y-map", "y-legal", "y-classified", "y-coupon", "y-masthead", "y-listing")
VISUAL_ORDER = ("v-photo", "v-cartoon", "v-ad", "v-map")

#: Event type -> display group, kind, order.
EVENT_GROUPS = {
    "concert": ("Music", "nightlife", 1),
    "music": ("Music", "nightlife", 1),
    "film": ("Film", "nightlife", 2),
    "theater": ("Theater", "nightlife", 3),
    "race": ("Sport & Racing", "nightlife", 4),
    "exhibition": ("Exhibitions", "civic", 5),
    "civic": ("Civic Life", "civic", 6),
    "club_engagement": ("Clubs & Societies", "civic", 7),
    "other": ("Other", "civic", 8),
}

#: Detector labels -> object class; others are articles.
LABEL_CLASSES = {
    "cartoon_or_advertisement": "advertisement", "image_caption": "caption", "masthead": "masthead", "newspaper_header": "masthead", "page_number": "filler_slug",
    "photograph": "illustration", "table": "listing", "image": "illustration", "chart": "illustration", "header_image": "illustration", "footer_image": "illustration",
    "figure_title": "caption", "vision_footnote": "caption", "footnote": "caption", "header": "filler_slug", "footer": "filler_slug", "number": "filler_slug", "seal": "illustration",
}

#: Words that may end a headline with a full stop.
ABBREVIATIONS = ("co", "inc", "rd", "ave", "blvd", "st", "jr", "sr", "dr", "mr", "mrs", "no", "vol", "ltd")

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
