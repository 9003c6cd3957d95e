"""Court geometry, thresholds and word lists that results depend on."""

# Court frame (court units; x grows to the right, y from far to near baseline).
SINGLES_LEFT, SINGLES_RIGHT = 423, 1242
DOUBLES_LEFT, DOUBLES_RIGHT = 286, 1379
FAR_BASELINE, NEAR_BASELINE = 561, 2935
NET_Y, CENTRE_X = 1748, 832
FAR_SERVICE, NEAR_SERVICE = 1110, 2386
METRES_PER_UNIT = 10.97 / 1117

# Service boxes as (x_min, y_min, x_max, y_max), checked in this order.
SERVICE_BOXES = {
    "far_left": (423, 1110, 832, 1748),
    "far_right": (832, 1110, 1242, 1748),
    "near_left": (423, 1748, 832, 2386),
    "near_right": (832, 1748, 1242, 2386),
}

# The 14 court keypoints (kp number -> x, y).
COURT_KEYPOINTS = [
    (286, 561), (1379, 561), (286, 2935), (1379, 2935), (423, 561), (423, 2935), (1242, 561),
    (1242, 2935), (423, 1110), (1242, 1110), (423, 2386), (1242, 2386), (832, 1110), (832, 2386),
]

# Four-keypoint court configurations used for calibration (number -> keypoints).
CONFIGURATIONS = {
    1: (0, 1, 2, 3), 2: (4, 6, 5, 7), 3: (4, 1, 5, 3), 4: (0, 6, 2, 7), 5: (8, 9, 10, 11),
    6: (8, 9, 5, 7), 7: (4, 6, 10, 11), 8: (6, 1, 7, 3), 9: (0, 4, 2, 5), 10: (8, 12, 10, 13),
    11: (12, 9, 13, 11), 12: (10, 11, 5, 7),
}

# Event detection.
LINE_MARGIN = 20
EVENT_MIN_SPEED = 3.0
TURN_DEG = 50
HIT_MIN_SPEED = 5.0
NMS_FRAMES = 5
PROXIMITY = 350
SEARCH_RADIUS = 2
DEDUP_GAP = 1
STILL = 1e-3  # court units; two fits of a frame agree to about 1e-9
TIE = 1e-9    # below what any mean of rounded values can differ by, above floating-point noise

# Point segmentation.
INACTIVITY_GAP = 50
MIN_POINT_EVENTS = 2
LOW_CONFIDENCE = 0.7
LOW_CONFIDENCE_RUN = 5

# Contact detection.
EMA_ALPHA = 0.3
CONTACT_ANGLE = 80
CONTACT_MIN_SPEED, CONTACT_MAX_SPEED = 5.0, 300.0
COOLDOWN = 12
STABLE_FRAMES = 3

# Track cleaning.
OUTLIER_PX = 100
MIN_SUBTRACK = 5
MAX_GAP = 4
MAX_GAP_PX = 80
SPEED_CAP = 80.0

# Calibration and players.
MIN_KEYPOINTS = 4
MAX_CARRY = 5
PLAYER_MIN_CONFIDENCE = 0.5
COURT_MARGIN = 200

# Serve classification baselines.
SERVE_FAR_Y, SERVE_NEAR_Y = 0, 3496
SERVE_MIN_SPEED = 6.0

SHOT_CLASSES = ("backhand", "forehand", "neutral", "serve")
PLAYERS = ("player_a", "player_b")
# End reasons that count against the last hitter in rebuilt statistics.
ERROR_REASONS = ("OUT", "NET", "NET_FAULT", "OUT_LONG", "OUT_WIDE")

# Label quality gates.
EXIT_MIN_FRAMES = 500
EXIT_PLAYER, EXIT_BALL, EXIT_LINES, EXIT_NET, EXIT_FP = 0.80, 0.70, 0.75, 0.75, 0.10
PLATEAU = 0.03
