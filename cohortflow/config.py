"""Configuration dimensions.

Two kinds of constants live here:

* FIXED VALUES that must equal the study's definitions for results to be
  comparable (comorbidity list, labels, status labels, Charlson weights,
  cohort names, rare labels, visit-type codes, separator).  They are stated
  plainly, in their natural order, and must not be edited.
* Values of this repository's own binding of the driver's TPC-H-ish tables to
  the clinical model (lexicon, cue words, code rules).  Those are ours.

Everything is turned into small Spark DataFrames with explicit schemas by
``cohortflow.sources.dims``; their size is fixed by construction, which is
what makes broadcasting them safe at any data scale.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES (study definitions) -- do not edit
# --------------------------------------------------------------------------

# Cohort projects, in order; a person's project is hash(birth date) % 3.
CSE_PROJECTS = ["cse200093", "cse180032", "cse200055"]
SPLIT_RATIO = 10  # number of strata
TEST_THRESHOLD = 3  # strata >= 3 form the test set

# Labels with too few cases: excluded from micro/macro/weighted averages and
# from the synthetic "Total" label.
RARE_COMORBS = ["Hémiplégie", "SIDA"]

# Visit-type codes -> visit type.
VISIT_TYPE_MAPPING = {"I": "Hosp", "II": "Incomp", "U": "Urg", "O": "Ext"}

# Patient type -> (visit type, note class).
PATIENT_TYPES = {
    "inpatient": ("Hosp", "CR:CRH-HOSPI"),
    "outpatient": ("Ext", "CR:CR-CONS"),
}

ABSENCE = "0:Absence"

# Snippet separator: two newlines, 30 '#', two newlines.
SNIPPET_SEP = "\n\n" + 30 * "#" + "\n\n"

# Comorbidities: pipe_name, label_name, selection_type, status labels
# {int: label} (binary ones map 1 -> True / 0 -> False), Charlson weight
# (base revision), Charlson weight (Quan revision), family, position.
# List-type weights are [weight for value 1, weight for value 2].
# peripheral_vascular_disease has no base weight (None: it adds nothing).
BINARY_STATUS = {1: True, 0: False}
COMORBIDITIES = [
    ("myocardial_infarction", "IDM", "binary", BINARY_STATUS, 1, 0, None, 0),
    ("congestive_heart_failure", "Insuff. Card. Cong.", "binary", BINARY_STATUS, 1, 2, None, 1),
    ("peripheral_vascular_disease", "Maladies Vasc. Periph.", "binary", BINARY_STATUS, None, 0, None, 2),
    ("cerebrovascular_accident", "Maladies Cérébro-Vasc.", "binary", BINARY_STATUS, 1, 0, None, 3),
    ("dementia", "Démence", "binary", BINARY_STATUS, 1, 2, None, 4),
    ("COPD", "Maladies Pulmo. Chron.", "binary", BINARY_STATUS, 1, 1, None, 5),
    ("connective_tissue_disease", "Maladies des Tissus Conj.", "binary", BINARY_STATUS, 1, 1, None, 6),
    ("peptic_ulcer_disease", "Ulcères gastriques", "binary", BINARY_STATUS, 1, 0, None, 7),
    ("CKD", "Maladies du Rein", "binary", BINARY_STATUS, 2, 1, None, 11),
    ("AIDS", "SIDA", "binary", BINARY_STATUS, 6, 4, None, 15),
    ("hemiplegia", "Hémiplégie", "binary", BINARY_STATUS, 2, 2, None, 10),
    ("diabetes", "Diabète", "list",
     {2: "2:Avec atteintes d'organes", 1: "1:Sans atteintes d'organes", 0: "0:Absence"},
     [1, 2], [0, 1], None, 9),
    ("liver_disease", "Maladies du Foie", "list",
     {2: "2:Modérée/Sévère", 1: "1:Faible", 0: "0:Absence"},
     [1, 3], [2, 4], None, 8),
    ("solid_tumor", "Cancer", "list",
     {2: "2:Métastasé", 1: "1:Solide", 0: "0:Absence"},
     [2, 6], [2, 6], "Cancer", 12),
    ("leukemia", "Leucemie", "binary", BINARY_STATUS, 2, 2, "Cancer", 13),
    ("lymphoma", "Lymphome", "binary", BINARY_STATUS, 2, 2, "Cancer", 14),
    ("alcohol", "Alcool", "list",
     {2: "2:Sevré", 1: "1:Présent", 0: "0:Absence"},
     [0, 0], [0, 0], None, 16),
    ("tobacco", "Tabagisme", "list",
     {2: "2:Sevré", 1: "1:Présent", 0: "0:Absence"},
     [0, 0], [0, 0], None, 17),
]

# Display names (identity when unknown).
DISPLAY_NAMES = {
    "cse180032": "Cardiology",
    "cse200055": "Oncology",
    "cse200093": "Rheumatology",
    "Overall": "Overall",
    "Alcool": "Alcohol Consumption",
    "Cancer": "Solid tumor",
    "Diabète": "Diabetes",
    "Démence": "Dementia",
    "Hémiplégie": "Hemiplegia",
    "IDM": "Myocardial infarction",
    "Insuff. Card. Cong.": "Congestive heart failure",
    "Leucemie": "Leukemia",
    "Lymphome": "Lymphoma",
    "Maladies Cérébro-Vasc.": "Cerebrovascular disease",
    "Maladies Pulmo. Chron.": "Chronic pulmonary disease",
    "Maladies Vasc. Periph.": "Peripheral vascular disease",
    "Maladies des Tissus Conj.": "Rheumatologic disease",
    "Maladies du Foie": "Liver disease",
    "Maladies du Rein": "Renal disease",
    "SIDA": "AIDS",
    "Tabagisme": "Tobacco consumption",
    "Ulcères gastriques": "Peptic ulcer disease",
}

# Care-site code -> trigram.
CARE_SITE_TRIGRAMS = {
    "014": "APR", "028": "ABC", "095": "AVC", "005": "BJN", "009": "BRK",
    "010": "BCT", "011": "BCH", "033": "BRT", "016": "BRC", "042": "CFX",
    "019": "CRC", "021": "CCH", "022": "CCL", "029": "ERX", "036": "GCL",
    "075": "EGP", "038": "HND", "026": "HMN", "099": "HAD", "041": "HTD",
    "032": "JVR", "044": "JFR", "047": "LRB", "049": "LRG", "053": "LMR",
    "061": "NCK", "096": "PBR", "066": "PSL", "068": "RPC", "069": "RMB",
    "070": "RDB", "072": "RTH", "073": "SAT", "079": "SPR", "076": "SLS",
    "084": "SSL", "087": "TNN", "088": "TRS", "090": "VGR", "064": "VPD",
    "INC": "INCONNU",
}

# Bootstrap defaults.
BOOTSTRAP_ITERATIONS = 200
CI_QUANTILES = (0.025, 0.975)

# --------------------------------------------------------------------------
# Binding of the driver's tables (ours, not the study's)
# --------------------------------------------------------------------------

# Order status -> raw visit-type code.
ORDER_STATUS_TO_VISIT_CODE = {"F": "I", "O": "O", "P": "U"}

# Dictionary of terms -> (label_name, label_value).  Matching is whole-word
# and case-insensitive; words of multi-word terms are separated by spaces.
LEXICON = [
    ("thing", "IDM", "1"),
    ("erble", "Insuff. Card. Cong.", "1"),
    ("thorth", "Maladies Vasc. Periph.", "1"),
    ("atshsh", "Maladies Cérébro-Vasc.", "1"),
    ("enber", "Démence", "1"),
    ("einau", "Maladies Pulmo. Chron.", "1"),
    ("tionor", "Maladies des Tissus Conj.", "1"),
    ("bleat", "Ulcères gastriques", "1"),
    ("ingly", "Maladies du Rein", "1"),
    ("tition", "SIDA", "1"),
    ("ananble", "Hémiplégie", "1"),
    ("attion", "Diabète", "1"),
    ("bleble", "Diabète", "2"),
    ("treai", "Maladies du Foie", "1"),
    ("quetion", "Maladies du Foie", "2"),
    ("thrent", "Cancer", "1"),
    ("license", "Cancer", "2"),
    ("ungsch", "Leucemie", "1"),
    ("geein", "Lymphome", "1"),
    ("tionç", "Alcool", "1"),
    ("éque", "Tabagisme", "1"),
    ("ciónción", "Tabagisme", "2"),
    ("erble of", "Insuff. Card. Cong.", "1"),
    ("the thing", "IDM", "1"),
]

# Qualifier cue words (whole-word, case-insensitive) looked for in the part
# of the entity's sentence that precedes it.
NEGATION_CUES = ["not", "no", "nicht", "kein", "pas", "sans", "sin", "without"]
HYPOTHESIS_CUES = ["if", "may", "si", "wenn", "ob", "possible"]
FAMILY_CUES = ["family", "mother", "father", "sich", "su"]

# Keyword announcing a reported comorbidity score in a note, and the window
# (characters) after it in which the score digits are searched.
SCORE_KEYWORD = "version"
SCORE_WINDOW = 20

# Seeds / buckets of the method simulations used for evaluation.
SEED = 42

# Note type in the title of an annotation snippet, by patient type.
NOTE_TITLES = {"inpatient": "CR-HOSP", "outpatient": "CR-CONS"}
