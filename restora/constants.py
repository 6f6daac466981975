"""Column names, defaults and fixed clinical values."""

PATIENT, PROTOCOL, PRESCRIPTION, SESSION = "PATIENT_ID", "PROTOCOL_ID", "PRESCRIPTION_ID", "SESSION_ID"
BY_PP = [PATIENT, PROTOCOL]
NOT_PERFORMED = "NOT_PERFORMED"

#: Protocols per patient, days, protocols a day, and the weights of adherence, progress and fit.
TOP_N, DAYS, PER_DAY, WEIGHTS = 12, 7, 5, (1.0, 1.0, 1.0)
EWMA_ALPHA, SMOOTH_WINDOW, SMOOTH_ORDER, SLOPE_WINDOW = 0.5, 7, 2, 7

# Largest score of each clinical subscale.
SCALE_MAXIMA = {
    "ACT_AU": 10, "ACT_QOM": 10, "ASH_PROXIMAL": 4, "BARTHEL": 100, "FSS": 63, "HDRS17": 52,
    "FM_A": 36, "FM_B": 10, "FM_C": 14, "FM_D": 6, "FM_TOTAL": 66, "MA_DISTAL": 4, "VAS": 10,
    "MOCA_VISUO": 5, "MOCA_NAMING": 3, "MOCA_ATTENTION": 6, "MOCA_LANGUAGE": 3, "MOCA_ABSTRACTION": 2,
    "MOCA_RECALL": 5, "MOCA_ORIENTATION": 6, "MOCA_TOTAL": 30,
    "ARAT_GRASP": 15, "ARAT_GRIP": 10, "ARAT_PINCH": 18, "ARAT_GROSS": 14, "ARAT_TOTAL": 57,
}

# Other names of the subscales.
SCALE_ALIASES = {
    "BARTHEL": ["Barthel Index", "BI"],
    "VAS": ["Visual Analog Scale", "Other.Pain"],
    "FM_A": ["Fugl-Meyer.FM_A"],
    "FM_B": ["Fugl-Meyer.FM_B"],
    "FM_C": ["Fugl-Meyer.FM_C"],
    "FM_D": ["Fugl-Meyer.FM_D"],
    "MOCA_VISUO": ["MoCA.Visuospatial/Executive"],
    "MOCA_NAMING": ["MoCA.Naming"],
    "MOCA_ATTENTION": ["MoCA.Attention"],
    "MOCA_LANGUAGE": ["MoCA.Language"],
    "MOCA_ABSTRACTION": ["MoCA.Abstraction"],
    "MOCA_RECALL": ["MoCA.Delayed Recall", "MoCA.DelayedRecall"],
    "MOCA_ORIENTATION": ["MoCA.Orientation"],
    "MOCA_TOTAL": ["MoCA.Total"],
    "ARAT_GRASP": ["ARAT.Grasp"],
    "ARAT_GRIP": ["ARAT.Grip"],
    "ARAT_PINCH": ["ARAT.Pinch"],
    "ARAT_GROSS": ["ARAT.Gross movement", "ARAT.GrossMovement"],
    "ARAT_TOTAL": ["ARAT.Total"],
    "FSS": ["Other.Fatigue"],
    "HDRS17": ["Other.Depression"],
}

# Protocol attributes whose mean stands for a subscale.
SCALE_FEATURES = {
    "ARAT_GRASP": ["REACHING", "GRASPING"],
    "ARAT_GRIP": ["OBJECT_MANIPULATION"],
    "ARAT_PINCH": ["PINCHING", "PRONATION_SUPINATION"],
    "ARAT_GROSS": ["PROXIMAL_COORDINATION", "PROCESSING_SPEED", "MOTOR_PLANNING", "ROM_VERTICAL", "ROM_HORIZONTAL"],
    "MOCA_ATTENTION": ["ATTENTION", "SUSTAINED_ATTENTION", "DISTRACTOR_INHIBITION", "STIMULUS_RESPONSE"],
    "MOCA_VISUO": ["OBJECT_TRACKING", "MOTOR_PLANNING_COORDINATION"],
    "MOCA_RECALL": ["MEMORY_WM", "RECALL", "SEMANTIC_MEMORY"],
    "MOCA_NAMING": ["WORD_RETRIEVAL", "SEMANTIC_PROCESSING", "VERBAL_REHEARSAL"],
    "MOCA_LANGUAGE": ["WORD_RETRIEVAL", "SEMANTIC_PROCESSING", "VERBAL_REHEARSAL"],
    "MOCA_ORIENTATION": ["SPATIAL_CONTEXT"],
    "MOCA_ABSTRACTION": ["SEMANTIC_GROUPING", "SEMANTIC_RULE_EXECUTION"],
}

# Protocols that may be recommended.
ALLOWED_PROTOCOLS = [200, 201, 202, 203, 204, 205, 206, 208, 209, 210, 214, 215, 217, 218, 219, 221, 222, 223, 224, 225, 226, 227, 231]

METRICS = ["PPF", "ADHERENCE_RECENT", "DELTA_DM", "WEEKS_SINCE_START", "SESSION_INDEX", "USAGE", "USAGE_WEEK", "DAYS", "SCORE"]
