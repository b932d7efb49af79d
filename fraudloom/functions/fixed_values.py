"""Thresholds, weights, word lists and patterns the results depend on.

Nothing in this module is logic.  Every number and list here is part of the
behaviour contract, so it is kept as plain text in one place.
"""

# --- identity numbers -------------------------------------------------------
PAN_SHAPE = "[A-Z]{5}[0-9]{4}[A-Z]"
AADHAAR_SHAPE = "[2-9][0-9]{3}\\s?[0-9]{4}\\s?[0-9]{4}"
DOB_SHAPE = "[0-3]?\\d[/\\-.][0-1]?\\d[/\\-.](?:19|20)\\d{2}"
PAN_HOLDERS = {
    "A": "Association of Persons",
    "B": "Body of Individuals",
    "C": "Company",
    "F": "Firm",
    "G": "Government",
    "H": "Hindu Undivided Family",
    "J": "Artificial Juridical Person",
    "L": "Local Authority",
    "P": "Individual",
    "T": "Trust",
}
# glyph confusions, letters read where a digit belongs and the reverse
LETTERS_FOR_DIGITS = "OQDILZSBGTA"
DIGITS_FOR_LETTERS = "00011258674"
DIGITS_READ = "012586"
LETTERS_MEANT = "OIZSBG"
VERHOEFF_BASE_PERMUTATION = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]

# --- behaviour --------------------------------------------------------------
FLIGHT_FLOOR_MS = 15.0
DWELL_CV_FLOOR = 0.08
FLIGHT_CV_FLOOR = 0.10
TYPING_CPS_LIMIT = 14.0
FORM_SECONDS_FLOOR = 15.0
ROUND_SLEEPS_S = [30.0, 60.0, 90.0, 120.0, 180.0, 240.0, 300.0, 600.0]
SLEEP_TOLERANCE_S = 0.75
STRAIGHTNESS_LIMIT = 0.97
MIN_POINTER_POINTS = 8
POINTER_DT_CV_FLOOR = 0.12
PATH_ENTROPY_FLOOR = 0.35
MIN_RHYTHM_KEYS = 12
MODEL_ALERT = 0.5
CONFIDENT_KEYS = 35
PAUSE_MS = 2000.0
MIN_DWELL_MS = 1.0
MAX_DWELL_MS = 2000.0
FLIGHT_CUT_MS = (-50.0, 5000.0)
SENSITIVE_FIELDS = ["pan", "id_number", "claimed_id_number", "aadhaar", "dob", "claimed_dob", "account_number"]
AUTOMATION_AGENTS = ["headlesschrome", "phantomjs", "electron/", "puppeteer", "playwright"]
REGION_UTC_MINUTES = {
    "IN": 330, "PK": 300, "BD": 360, "LK": 330, "NP": 345, "GB": 0, "IE": 0, "PT": 0,
    "DE": 60, "FR": 60, "ES": 60, "IT": 60, "PL": 60, "NL": 60, "SE": 60, "RU": 180,
    "TR": 180, "SA": 180, "AE": 240, "IR": 210, "CN": 480, "SG": 480, "MY": 480,
    "PH": 480, "HK": 480, "JP": 540, "KR": 540, "AU": 600, "NZ": 720, "US": -300,
    "CA": -300, "BR": -180, "MX": -360, "NG": 60, "ZA": 120, "KE": 180, "EG": 120,
}
LOCALE_TOLERANCE_MIN = 240.0
# feature -> the band an ordinary person falls in
HUMAN_BANDS = {
    "dwell_mean_ms": (55.0, 190.0),
    "dwell_cv": (0.08, 0.75),
    "flight_cv": (0.10, 3.0),
    "flight_min_ms": (15.0, 400.0),
    "typing_speed_cps": (0.6, 14.0),
    "rollover_rate": (0.02, 0.6),
    "mouse_straightness": (0.0, 0.97),
    "mouse_path_entropy": (0.35, 1.0),
    "mouse_dt_cv": (0.12, 2.0),
    "total_time_s": (15.0, 600.0),
}

# --- file metadata ----------------------------------------------------------
GENERATOR_TOKENS = [
    "stable diffusion", "stablediffusion", "midjourney", "dall", "dalle", "comfyui",
    "automatic1111", "invokeai", "firefly", "novelai", "flux", "sdxl", "gan",
]
EDITOR_TOKENS = [
    "photoshop", "gimp", "lightroom", "affinity", "pixelmator", "paint.net",
    "krita", "canva", "figma", "inkscape",
]
UPSCALED_BELOW = 0.57
SOFT_BELOW = 0.62
METADATA_CAP = 0.82
BEHAVIOUR_CAP = 0.80
HARD_WEIGHT = 0.90

# --- detectors, fusion and decisions ---------------------------------------
DETECTORS = ["selfie_deepfake", "liveness_video", "id_forensics", "face_match", "metadata_exif", "behavioral"]
FUSED_DETECTORS = ["selfie_deepfake", "liveness_video", "id_forensics", "face_match", "metadata_exif"]
DETECTOR_LABELS = {
    "selfie_deepfake": "Selfie Deepfake Detector",
    "liveness_video": "Liveness Video Analyzer",
    "id_forensics": "ID Document Forensics",
    "face_match": "Face Match (Selfie vs ID)",
    "metadata_exif": "Metadata / EXIF Auditor",
    "behavioral": "Behavioral Biometrics",
}
FUSION_WEIGHTS = {
    "selfie_deepfake": 1.00,
    "liveness_video": 0.85,
    "id_forensics": 1.25,
    "face_match": 1.20,
    "metadata_exif": 0.70,
    "behavioral": 1.35,
}
SAME_PERSON = 0.8169
SUPERSEDED_SAME_PERSON = 0.5198
SAME_IMAGE_BITS = 8
FACE_BAND = (0.4065, 0.9878)
FACE_LINK_LIMIT = 25
ASSET_LINK_LIMIT = 15
APPLICANT_SIZES = [20, 100, 500, 1000, 5000, 50000]
PATTERN_LABELS = {
    "reused_kyc_kit": "Reused KYC kit",
    "onboarding_ring": "Onboarding ring (one face, many identities)",
    "automated_submission": "Automated submission (bot-filled form)",
    "assisted_submission": "Form filled by someone other than the applicant",
    "reused_id_selfie": "Selfie copied from ID photo",
    "impersonation": "Impersonation (selfie ≠ ID holder)",
    "synthetic_identity": "Fully synthetic identity",
    "face_swap_liveness": "Face-swapped liveness video",
    "generated_selfie": "AI-generated selfie",
    "tampered_document": "Tampered ID document",
    "invalid_document": "Structurally invalid ID number",
    "recaptured_screen": "Screen re-capture / photo of a photo",
    "stale_or_edited_media": "Stale or edited media",
    "clean": "No attack pattern detected",
}
BOT_RULES = [
    "environment:automation", "keystroke:below_human_floor", "keystroke:uniform_dwell",
    "keystroke:uniform_flight", "pointer:uniform_sampling", "timing:hardcoded_sleep",
]
GENERATOR_LABELS = {
    "stable_diffusion": "Stable Diffusion (latent diffusion)",
    "sdxl": "SDXL / SDXL-Turbo",
    "stylegan": "StyleGAN family",
    "faceswap": "Face-swap compositing (DeepFaceLab/Roop family)",
    "gan_other": "Other GAN",
    "real": "No generator - camera capture",
}
TONE_BINS = [(55.0, "very_light"), (41.0, "light"), (28.0, "intermediate"), (10.0, "tan"), (-30.0, "brown"), (-999.0, "dark")]
DETECTOR_TARGETS = {
    "selfie_deepfake": ["generated_selfie", "synthetic_identity"],
    "liveness_video": ["face_swap_liveness"],
    "id_forensics": ["tampered_document", "invalid_document", "synthetic_identity"],
    "face_match": ["impersonation", "reused_id_selfie", "generated_selfie"],
    "metadata_exif": ["stale_or_edited_media", "recaptured_screen"],
}
FRAUD_ONLY_VALUES = {"generated": "cameras do not name a diffusion model in the software tag"}

# --- policy -----------------------------------------------------------------
CLASS_DEFAULTS = {
    "min_risk_for_reject": 0.75, "min_risk_for_review": 0.40, "require_liveness": True,
    "require_id_document": True, "require_behavioral": False, "abstain_band": 0.05,
    "webhook_min_score": 0.90, "audit_retention_days": 365, "avg_fraud_loss_inr": 85000.0,
    "merchant_ltv_inr": 42000.0, "false_reject_abandon_prob": 0.35,
}
SHIPPED_DEFAULTS = {**CLASS_DEFAULTS, "min_risk_for_reject": 0.80, "min_risk_for_review": 0.45}
SHIPPED_OVERLAYS = {
    "crypto_exchange_01": {"min_risk_for_reject": 0.60, "min_risk_for_review": 0.25, "avg_fraud_loss_inr": 250000.0},
    "gig_marketplace_02": {
        "min_risk_for_reject": 0.88, "min_risk_for_review": 0.45, "require_liveness": False,
        "avg_fraud_loss_inr": 12000.0, "merchant_ltv_inr": 9000.0,
    },
}

# --- keystroke model --------------------------------------------------------
CORE_FEATURES = [
    "dwell_mean", "dwell_std", "dwell_cv", "dwell_median", "dwell_p10", "dwell_p90",
    "dwell_min", "dwell_max", "dwell_iqr", "flight_mean", "flight_std", "flight_cv",
    "flight_median", "flight_p10", "flight_p90", "flight_min", "flight_max", "flight_iqr",
    "rollover_rate", "dwell_flight_corr", "dwell_unique_ratio", "flight_unique_ratio",
]
CONTEXT_FEATURES = ["pause_rate", "typing_speed_cps", "backspace_rate"]
SESSION_KEYS = 110
BACKSPACE_KEYCODE = "8"
