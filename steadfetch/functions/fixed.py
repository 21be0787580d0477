"""Fixed values. They must equal the published ones for results to agree."""

# Topics for the distraction rewrites, in their published order.
TOPICS = [
    "classical music", "jazz history", "modern cinema", "board games", "chess openings",
    "marine biology", "entomology", "ornithology", "botany", "mycology",
    "ancient Egypt", "Roman empire", "medieval Europe", "Renaissance art", "Ming dynasty",
    "quantum physics", "organic chemistry", "geology", "meteorology", "astronomy",
    "computer science", "cryptography", "linguistics", "philosophy", "economics",
    "Formula 1 racing", "cricket history", "olympics", "mountaineering", "surfing culture",
    "Japanese folklore", "Norse mythology", "African literature", "South American cuisine",
    "coffee production", "wine regions", "tea ceremony", "pottery techniques",
    "architecture", "urban planning", "transportation history", "aviation",
    "textile industry", "paleontology", "archaeology", "genetics", "neuroscience",
    "world currencies", "postal systems", "cartography", "lexicography",
]

# Words that give a rewrite away as a correction.
HEDGE_WORDS = [
    "false", "falsely", "mistaken", "mistakenly", "wrong", "incorrect", "incorrectly",
    "misconception", "setting aside", "despite", "ignoring", "contrary", "although",
    "even though", "in reality", "actually", "supposedly", "allegedly", "putting aside",
    "correcting", "though", "really", "truly",
]

# Rewrite type of the five slots of a query, by query_idx % 3.
SLOT_PATTERNS = [
    [1, 2, 3, 1, 2],
    [2, 3, 1, 2, 3],
    [3, 1, 2, 3, 1],
]

# Labels a model may put before its answer.
OUTPUT_LABELS = ["Rewritten", "Sentence", "Output", "Answer"]

ABSTAIN_TEXT = "Abstain: Insufficient reliable evidence"
UNKNOWN_BELIEF = "Unknown"
MISSING_AVOID = "<unknown>"
NOTE_PREFIX = "[Note]:"
LISTWISE_MODE = "listwise+pointwise"
POINTWISE_MODE = "pointwise_only"

CHUNK_WORDS = 200
MIN_CHUNK_WORDS = 30
CONTEXT_CHARS = 1400
QUESTION_CHARS = 500
PREDICTION_CHARS = 200
MAX_GOLDS = 8
EVIDENCE_CHARS = 1500

# User messages of the marking and answering steps.
TEACHER_MESSAGE = "Context: {ctx}\n\nQuestion: {q}"
JUDGE_MESSAGE = (
    "Question: {q}\nGround-truth answer(s): {golds}\nPrediction: {pred}\n\n"
    "Does the prediction match any of the ground truths? (yes/no)"
)
ANSWER_MESSAGE = "Evidence:\n{evidence}\n\nQuestion: {q}"
