"""Texts that must read exactly like this for results to agree.

Each template is filled with `str.format` style fields by `functions.model_text`.
"""

CATEGORY_PROMPT = (
    "You are filtering category names for a robot embodied interaction dataset. "
    "Keep only categories that usually have meaningful human-interaction or operable regions "
    "that a robot may need to localize from language instructions. "
    "Reject passive scenery, materials, abstract classes, or categories without a stable operable-part concept. "
    "Return JSON only with keys: interactive_object, short_reason. "
    "Category name: {category}."
)

CANDIDATE_PROMPT = (
    "You are filtering object instances for a 3D interaction dataset. "
    "The masked object image is the primary evidence, while the original image is weak context only. "
    "Judge whether the instance is recognizable from the masked region only, "
    "clear not blurry, not severely cropped, and belongs to an interactive object category. "
    "Return JSON only with keys: recognizable_from_mask_only, clear_not_blurry, "
    "severe_crop, interactive_object, pass, short_reason. "
    "Target category hint: {category}."
)

PART_PROMPT = (
    "You are generating part prompts for a 3D interaction dataset. "
    "Focus only on interactive or operable parts. "
    "Return at most {max_parts} parts for the object category '{category}'. "
    "If the category has no stable operable parts, return an empty parts list. "
    "Use English only. "
    'Return JSON only in the form {{"parts":[{{"part_name":"...","prompt":"..."}}]}}. '
    "Each prompt should use the exact pattern '{seat_prompt}'. "
    "For example, use 'the seat of the chair' instead of 'chair seat'."
)

CONSISTENCY_PROMPT = (
    "You are verifying part prompts for a 3D interaction dataset. "
    "The images show the specific object instance and its rendered views. "
    "Keep only parts that are visually consistent with this specific instance or clearly supported by "
    "the rendered structure. "
    "It is valid to return zero parts if none are reliable for this instance. "
    "Do not keep speculative parts that are common for the category but not visible or not supported here. "
    "Object category: '{category}'. "
    "Candidate parts: {parts_json}. "
    'Return JSON only in the form {{"parts":[{{"part_name":"...","prompt":"..."}}]}}.'
)

INSTRUCTION_PROMPT = (
    "You are writing English spoken commands for a human-to-robot interaction dataset used to train a "
    "text-conditioned affordance decoder. "
    "Downstream use case: a person speaks to a robot, and the robot must infer which object region it should "
    "grasp, touch, pull, press, hold, or manipulate. "
    "You are given one masked object image showing the target object instance and a list of target parts that "
    "already have valid 3D labels. "
    "For each listed part, write exactly {per_part} short natural commands that a person could say to a household "
    "robot so that the listed part is the correct contact or manipulation region. "
    "Each command should sound like a real user request, not like dataset metadata or a part definition. "
    "The wording does not need to reuse the exact part name. Prefer realistic user language, including functional "
    "descriptions, everyday synonyms, and implicit references, as long as the target part remains the unique best "
    "match. It is still acceptable for some commands to mention the part directly when that sounds natural, but do "
    "not force exact label wording into every command. "
    "Within the same object, sibling parts must be clearly distinguishable from one another. "
    "Do not produce near-duplicate commands across different listed parts. "
    "Choose verbs, functional cues, and descriptions that make this part more likely than any sibling part on the "
    "same object. "
    "If two parts are similar, deliberately emphasize what would disambiguate them in a real interaction request. "
    "When sibling parts are easy to confuse, use mutually exclusive cues instead of overlapping generic wording. "
    "Do not assign the same vague words such as 'top', 'cover', 'open', or 'handle' to multiple sibling parts unless "
    "that wording is unavoidable and still clearly disambiguated. "
    "Before writing, compare all listed parts and make sure each part gets its own distinct interaction profile. "
    "Across the 3 commands for one part, try to cover different natural phrasings instead of minor rewrites of the "
    "same sentence. "
    "Favor interaction-oriented language such as handing, opening, pressing, pulling, holding, or grabbing when it "
    "fits the part. "
    "Do not mention coordinates, camera directions, image positions, or invisible context. "
    "Avoid vague references like 'this thing', 'that area', or commands that target the whole object when the listed "
    "part should be selected. "
    "Keep each instruction concise, ideally no more than {max_words} words. "
    "Use English only. Return JSON only in the form "
    '{{"parts":[{{"part_name":"...","instructions":["...","...","..."]}}]}}. '
    "In the JSON output, use exactly the provided part_name values as identifiers, keep the same part coverage, and "
    "do not omit any listed part. This identifier requirement applies only to the JSON keys, not to the wording of "
    "the spoken commands themselves. "
    "Object category: '{object}'.\n"
    "Target parts:\n"
    "{part_lines}"
)

PART_LINE = "- part_name: {part}; grounding_prompt: {prompt}"

# Fallback commands, tried in this order.
FALLBACK_INSTRUCTIONS = (
    "Grab the {object} by the {part}.",
    "Use the {part} on the {object}.",
    "Reach for the {part} of the {object}.",
    "Hold the {object} at the {part}.",
    "Move to the {prompt}.",
)

# Release checks.
TEXT_SUFFIXES = (
    ".cff", ".css", ".html", ".json", ".md", ".py", ".sh", ".svg", ".toml", ".ts", ".tsx", ".txt", ".yaml", ".yml",
)
RELEASE_METADATA = ("LICENSE", "CITATION.cff")
FORBIDDEN_DIRS = ("__pycache__", ".pytest_cache", "artifacts", "checkpoints", "outputs")
FORBIDDEN_SUFFIXES = (".ckpt", ".pem", ".pth", ".pt", ".safetensors")
IGNORED_DIRS = (".git", "dist", "node_modules", "playwright-report", "test-results")
MACHINE_PATH_PATTERN = r"/(?:disk|mnt)/"
SECRET_PATTERN = (
    r"(?i)(?:api[_-]?key|access[_-]?token|secret)\s*[:=]\s*['\"][A-Za-z0-9_./+-]{16,}['\"]"
)
MAX_FILE_BYTES = 10 * 1024 * 1024

# Metric names of the two delta reports.
DECODER_DELTA_KEYS = (
    "iou", "miou", "auc", "mae", "sim", "pred_pos", "truth_pos", "prob_mean", "prob_max", "valid_ratio",
)
FORMAL_SCORE_KEYS = ("iou", "weighted_iou", "pr_auc", "roc_auc", "precision", "recall", "f1")
FORMAL_ERROR_KEYS = ("mae", "weighted_mae", "support_mae")
