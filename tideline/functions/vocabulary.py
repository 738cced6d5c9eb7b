"""The closed vocabulary of the subscriber profile.

Fixed values: names, menus, wordings and formats below are part of the data
contract and are stated as they are.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------

ROW_KEY = "customerID"
LABEL = "Churn"
POSITIVE = "Yes"
FLAG = "Senior_Citizen"
RATIO = "avg_monthly"

FEATURES = (
    "gender",
    "Senior_Citizen",
    "Is_Married",
    "Dependents",
    "tenure",
    "Phone_Service",
    "Dual",
    "Internet_Service",
    "Online_Security",
    "Online_Backup",
    "Device_Protection",
    "Tech_Support",
    "Streaming_TV",
    "Streaming_Movies",
    "Contract",
    "Paperless_Billing",
    "Payment_Method",
    "Monthly_Charges",
    "Total_Charges",
)

NUMERIC_FEATURES = ("tenure", "Monthly_Charges", "Total_Charges")

_NO_YES = ("No", "Yes")
_ADD_ON = ("No", "No internet service", "Yes")

MENUS = {
    "gender": ("Female", "Male"),
    "Senior_Citizen": ("Yes", "No"),
    "Is_Married": _NO_YES,
    "Dependents": _NO_YES,
    "Phone_Service": _NO_YES,
    "Dual": ("No", "No phone service", "Yes"),
    "Internet_Service": ("DSL", "Fiber optic", "No"),
    "Online_Security": _ADD_ON,
    "Online_Backup": _ADD_ON,
    "Device_Protection": _ADD_ON,
    "Tech_Support": _ADD_ON,
    "Streaming_TV": _ADD_ON,
    "Streaming_Movies": _ADD_ON,
    "Contract": ("Month-to-month", "One year", "Two year"),
    "Paperless_Billing": _NO_YES,
    "Payment_Method": (
        "Bank transfer (automatic)",
        "Credit card (automatic)",
        "Electronic check",
        "Mailed check",
    ),
}

# Accepted wordings per dictionary feature, in declared order.
WORDINGS = {
    "gender": (
        ("male", "Male"),
        ("m", "Male"),
        ("female", "Female"),
        ("f", "Female"),
    ),
    "Internet_Service": (
        ("dsl", "DSL"),
        ("fiber", "Fiber optic"),
        ("fiber optic", "Fiber optic"),
        ("fibre", "Fiber optic"),
        ("fibre optic", "Fiber optic"),
        ("fiberoptic", "Fiber optic"),
        ("no", "No"),
    ),
    "Contract": (
        ("month to month", "Month-to-month"),
        ("one year", "One year"),
        ("two year", "Two year"),
    ),
    "Payment_Method": (
        ("mailed check", "Mailed check"),
        ("electronic check", "Electronic check"),
        ("e check", "Electronic check"),
        ("credit card", "Credit card (automatic)"),
        ("credit card automatic", "Credit card (automatic)"),
        ("bank transfer", "Bank transfer (automatic)"),
        ("bank transfer automatic", "Bank transfer (automatic)"),
    ),
}

SERVICE_FLAGS = (
    "Is_Married",
    "Dependents",
    "Phone_Service",
    "Dual",
    "Online_Security",
    "Online_Backup",
    "Device_Protection",
    "Tech_Support",
    "Streaming_TV",
    "Streaming_Movies",
    "Paperless_Billing",
)

YES_WORDS = ("yes", "y", "true", "subscribed")
NO_WORDS = ("no", "n", "false")
NO_INTERNET = ("no internet service", "No internet service")
NO_PHONE = ("no phone service", "No phone service")
NOT_SUBSCRIBED = ("not subscribed", "No")

REQUEST_KEYS = ("target_features", "filters", "out_of_scope")
NUMBER_SLOT = r"^[0-9]+(\.[0-9]+)?$"

REPLY_INVALID = (
    "I could not map that to a churn question with the allowed feature "
    "vocabulary — no prediction was made. Try naming features like contract "
    "type, internet service, or tenure."
)
REPLY_OUT_OF_SCOPE = (
    "I only answer customer-churn questions about a subscriber profile (for "
    "example: contract type, internet service, tenure). Try: 'Will a "
    "fiber-optic customer on month-to-month contract churn?'"
)
REPLY_UNMAPPED = (
    "I could not read a valid value for %s — no prediction was made. Try words "
    "like 'yes', 'Month-to-month', 'Fiber optic', or numeric amounts."
)
REPLY_ANSWER = (
    "Estimated churn probability %s — %s at threshold %s. "
    "Profile used: %s. Top drivers: %s."
)
REPLY_BASELINE = "baseline customer"
LABELS = ("Churner", "Not churner")

PRECISION_FLOOR = 0.55
AUC_BAND = (0.84, 0.88)
AUC_TOLERANCE = 0.01
SEEDS = (42, 43, 44)
TEST_SHARE = 0.2
FOLDS = 5
LATENCY_BUDGETS = {"e2e": 5.0, "first_token": 1.0}

# --- derived ----------------------------------------------------------------

CATEGORICAL_FEATURES = tuple(f for f in FEATURES if f not in NUMERIC_FEATURES)
PROFILE_COLUMNS = (ROW_KEY, *FEATURES, LABEL)
