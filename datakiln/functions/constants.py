"""Vocabulary of the curated image data set."""

# Class order is the index in multi-hot vectors.
CLASSES = ("low_res", "blur", "over_expo", "dark", "occlusion", "noise")
CLASS_CN = {"low_res": "低分辨率", "blur": "模糊", "over_expo": "过曝", "dark": "欠曝/黑屏", "occlusion": "遮挡/污渍", "noise": "压缩噪声"}
NORMAL = "normal"
SOURCES = ("real", "procedural", "aigc")
SPLITS = ("train", "val", "test", "eval")
SCENES = ("indoor", "outdoor", "night")
DIFFICULTIES = ("easy", "mid", "hard")
STRENGTH_DIFFICULTY = {"mild": "hard", "moderate": "mid", "severe": "easy"}
#: Which source stays when copies meet; others come after these.
KEEP_PRIORITY = {"real": 0, "procedural": 1, "aigc": 2}
OTHER_PRIORITY = 9
#: Phrases of generator prompts and the label each stands for.
PROMPT_LABELS = (
    ("motion blur", "blur"),
    ("overexposed", "over_expo"),
    ("very dark", "dark"),
    ("compression artifacts", "noise"),
    ("dirt and rain", "occlusion"),
    ("low resolution", "low_res"),
)
#: Limits of a clean frame: least side, least Laplacian variance and luminance range, by day and by night.
LEAST_SIDE = 320
LEAST_SHARPNESS = {"day": 80.0, "night": 60.0}
LUMINANCE = {"day": (45.0, 225.0), "night": (18.0, 88.0)}
TOO_SMALL, TOO_BLURRED, OUT_OF_RANGE = "分辨率过小", "天然模糊", "亮度越界"
ACCEPT_MACRO_F1, ACCEPT_RECALL = 0.85, {"blur": 0.95, "low_res": 0.95}
EVAL_COLUMNS = ("file", "sha1", "source", "origin_id", "labels", "scene", "difficulty", "defect_type", "longtail", "review_status")
