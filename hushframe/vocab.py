"""Closed vocabularies and word lists. Fixed values; operators take other lists as arguments where that makes sense."""

PII_TYPES = ["password", "cc-number", "current-password", "email", "tel", "aadhaar", "pan", "other"]
ACTION_TYPES = ["click", "type", "scroll", "done", "fill_profile"]
PROFILE_FIELDS = ["full_name", "email", "phone"]
PAGE_TARGET = "page"
PRIVACY_LABELS = ["person", "book"]

# Autocomplete tokens that name a PII type, and those that count as "other".
AUTOCOMPLETE_TYPES = {
    "current-password": "current-password", "password": "password", "cc-number": "cc-number", "email": "email", "tel": "tel",
    "tel-national": "tel", "tel-country-code": "tel", "tel-area-code": "tel", "tel-local": "tel", "tel-local-prefix": "tel",
    "tel-local-suffix": "tel", "tel-extension": "tel",
}
AUTOCOMPLETE_OTHER = ["new-password", "cc-csc", "cc-exp", "cc-exp-month", "cc-exp-year", "cc-name", "cc-given-name", "cc-additional-name", "cc-family-name", "cc-type"]

# Roles that tags and input types imply, and roles that make an element actionable.
ROLE_BY_TAG = {"button": "button", "select": "combobox", "textarea": "textbox"}
ROLE_BY_INPUT_TYPE = {"checkbox": "checkbox", "radio": "radio", "button": "button", "submit": "button", "reset": "button", "range": "slider", "search": "searchbox"}
ACTIONABLE_ROLES = ["button", "link", "checkbox", "radio", "switch", "menuitem", "tab", "option", "textbox", "combobox"]

# Phrases that mark an action as irreversible.
RISK_PHRASES = [
    "buy", "buy now", "purchase", "order now", "place order", "place your order", "proceed to buy", "proceed to pay", "proceed to payment",
    "pay", "pay now", "make payment", "submit payment", "complete payment", "complete purchase", "complete order", "confirm order",
    "confirm purchase", "confirm payment", "confirm and pay", "confirm & pay", "checkout", "proceed to checkout", "complete checkout",
    "book now", "book ticket", "book tickets", "confirm booking", "reserve now", "recharge", "recharge now", "top up", "topup", "donate",
    "donate now", "delete", "remove", "deactivate", "delete account", "deactivate account", "close account", "terminate account",
    "cancel account", "cancel subscription", "cancel membership", "cancel order", "cancel booking", "unsubscribe", "factory reset",
    "reset account", "erase", "empty trash", "permanently delete", "confirm", "order",
]

# Words that carry no task meaning.
STOPWORDS = [
    "a", "an", "the", "to", "of", "in", "on", "for", "with", "and", "or", "is", "are", "this", "that", "it", "its", "your", "you", "i", "my",
    "me", "please", "enter", "fill", "set", "as", "field", "value", "into", "from",
]
HIGH_VALUE_ROLES = ["button", "checkbox", "radio", "switch", "textbox", "combobox", "menuitem", "option", "tab", "slider", "searchbox"]

# Label and tone of each run outcome.
OUTCOMES = {
    "done": ("Done", "success"),
    "stopped": ("Stopped by you", "neutral"),
    "blocked": ("Stopped safely -- refused an unsafe action", "success"),
    "stalled": ("Stopped: no progress detected", "warning"),
    "max_steps_reached": ("Stopped: step limit reached", "warning"),
    "capture_failed": ("Failed: could not capture/detect the page", "error"),
    "analyze_failed": ("Failed: server request failed", "error"),
    "act_failed": ("Failed: could not complete the action", "error"),
    "section5_violation": ("Stopped: internal safety check failed", "error"),
    "failed": ("Failed: unexpected error", "error"),
}
PROFILE_PHRASES = {"full_name": "full name", "email": "email", "phone": "phone"}

# Backends whose names messages hold, and what is said of an error class or of an exception that a backend's message names.
BACKENDS = ["Gemini", "Claude", "Ollama"]
ERROR_TEXTS = {
    "no_response": "nothing answered", "network_error": "{url} cannot be reached", "SERVER_URL_NOT_PERMITTED": "{url} is not an allowed host", "STOPPED": "stopped on request",
    "PII_LEAK_DETECTED": "refused: personal data left in the request", "VLM_RESPONSE_SCHEMA_INVALID": "the model's answer has the wrong form", "http_422": "refused: malformed request (422)",
}
BACKEND_TEXTS = {
    "RateLimited": "too many calls, try again later or use another key", "CredentialsMissing": "no key is set on the server", "ModelNotFound": "the model's name is not known there",
    "ConnectionError": "the server cannot reach it", "APIError": "it reported an error of its own", "": "the call failed",
}
