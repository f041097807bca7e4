"""Table schemas, thresholds and word lists shared by every job."""

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Thresholds and word lists that results depend on.

SENTIMENTS = ("NEGATIVE", "NEUTRAL", "POSITIVE")
PLATFORMS = ("YouTube", "Twitter", "Reddit", "Telegram")

BASELINE_NEGATIVE_RATIO = 0.12
BASELINE_STD = 0.08
MIN_EFFECTIVE_STD = 0.02
CRISIS_Z = 2.0
CRITICAL_Z = 2.8
TEST_ALPHA = 0.01
ELEVATED_RATIO = 0.25
CRITICAL_RATIO = 0.40
AUDIT_CRITICAL_RATIO = 0.35
AUDIT_MODERATE_RATIO = 0.20
WINDOW_ROWS = 50
DASHBOARD_ROWS = 300
SURGE_PER_MINUTE = 25
EWMA_ROWS = 12

MAX_TERMS = 150
CLUSTERS = 3
SEED = 42

EMOJI_WORDS = (
    ("😡", " angry "),
    ("🤬", " furious "),
    ("🤮", " disgusting "),
    ("👎", " bad "),
    ("💔", " broken "),
    ("🔥", " fire "),
    ("❤️", " love "),
    ("😍", " amazing "),
    ("👍", " good "),
    ("🎉", " celebration "),
    ("💀", " dead "),
    ("🤡", " clown "),
    ("💩", " trash "),
)

SENTIMENT_WEIGHTS = {
    "scam": -3.5, "fraud": -3.8, "boycott": -3.2, "overheating": -2.8,
    "lagging": -2.5, "crashing": -3.0, "worst": -3.1, "broken": -2.9,
    "garbage": -3.4, "pathetic": -3.3, "useless": -3.0, "stolen": -3.5,
    "refund": -1.5, "flawless": 3.2, "masterpiece": 3.5, "smooth": 2.5,
    "recommended": 2.8,
}

SEVERE_WORDS = (
    "kill", "die", "murder", "threat", "burn", "shoot", "attack",
    "hang", "lynch", "destroy you", "suicide",
)
PROFANE_WORDS = (
    "fuck", "fucking", "shit", "bitch", "bastard", "asshole",
    "crap", "idiot", "moron", "dumbass", "scum", "trash",
)

CRISIS_KEYWORDS = ("down", "outage", "scam", "boycott", "broken", "bug", "crash", "leak")
TEXT_COLUMN_HINTS = ("text", "comment", "tweet", "content")
UPLOAD_TEXT_COLUMN_HINTS = TEXT_COLUMN_HINTS + ("body",)
UPLOAD_DEFAULTS = {"platform": "External CSV", "author": "User"}

DOMAIN_STOP_WORDS = (
    "video", "post", "comment", "channel", "people", "really", "just", "like", "get", "make",
)
# Spark's own English stop-word list (StopWordsRemover), spelled out so that SQL
# checks can use it without a session.
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own same
so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd
he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't
aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's
who's why's would
""".split())
STOP_WORDS = tuple(dict.fromkeys(ENGLISH_STOP_WORDS + DOMAIN_STOP_WORDS))

CHAT_SYSTEM_PROMPT = (
    "You are an enterprise social media intelligence engine. "
    "Analyze the provided post and return a strict JSON object with fields: "
    '"sentiment" (POSITIVE, NEUTRAL, or NEGATIVE), '
    '"is_toxic" (boolean), '
    '"toxicity_type" (NONE, HARASSMENT, HATE_SPEECH, or INSULT), '
    '"sarcasm" (boolean), and '
    '"explanation" (a concise 1-sentence reasoning).'
)
CHAT_EXPLANATION = "Standard social interaction."

H0_TEXT = "mu = {:.4f} (Brand is stable)"
H1_TEXT = "mu > {:.4f} (Brand is under crisis backlash)"
VERDICT_REJECT = "CRISIS DETECTED (Statistically Significant)"
VERDICT_KEEP = "NORMAL (Fail to reject H0)"

SKEW_LABELS = (
    "Fairly Symmetrical (Normal shape)",
    "Positively Skewed (Right-skewed tail: high backlash/toxicity outliers)",
    "Negatively Skewed (Left-skewed tail)",
)
KURTOSIS_LABELS = (
    "Leptokurtic (Heavy-tailed / High Outlier Risk)",
    "Platykurtic (Flat distribution)",
    "Mesokurtic (Near-Normal distribution)",
)
# ------------------------------------------------------------ end fixed values

COMMENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("platform", T.StringType()),
    T.StructField("source_target", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("clean_text", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("is_toxic", T.IntegerType()),
    T.StructField("toxicity_score", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
])

# Texts of the alert record.
ALERT_TEXTS = {
    "EMPTY": "No comments in buffer.",
    "CRITICAL": "EMERGENCY: Statistically abnormal crisis backlash detected! (Z=%.2f, p=%.4f)",
    "ELEVATED": "WARNING: Negative sentiment velocity rising above threshold (Z=%.2f)",
    "SAFE": "Normal brand sentiment velocity (Z=%.2f)",
}

COMMENT_DEFAULTS = {
    "platform": "Unknown", "source_target": "Stream", "author": "User",
    "raw_text": "", "clean_text": "", "sentiment": "NEUTRAL",
    "sentiment_score": 0.0, "is_toxic": 0, "toxicity_score": 0.0,
}

ALERTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("platform", T.StringType()),
    T.StructField("alert_level", T.StringType()),
    T.StructField("z_score", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("negative_ratio", T.DoubleType()),
    T.StructField("sample_size", T.IntegerType()),
    T.StructField("root_causes", T.StringType()),
    T.StructField("triggered_at", T.TimestampType()),
])

ALERT_DEFAULTS = {
    "platform": "All", "alert_level": "CRITICAL", "z_score": 0.0, "p_value": 1.0,
    "negative_ratio": 0.0, "sample_size": 0, "root_causes": "",
}


# Valence rules of Hutto & Gilbert (2014): fixed values.
BOOST, CAPITALS, NEGATED, EXCLAMATION, QUESTION, MANY_QUESTIONS = 0.293, 0.733, -0.74, 0.292, 0.18, 0.96
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
BOOST_BY_DISTANCE = (1.0, 0.95, 0.9)
NEGATIONS = tuple("""
aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't dont hadnt hasnt
havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't neednt needn't never none nope nor
not nothing nowhere oughtnt shant shouldnt wasnt werent oughtn't shan't shouldn't wasn't weren't without wont wouldnt
won't wouldn't rarely seldom despite
""".split())
INTENSIFIERS = tuple("""
absolutely amazingly awfully completely considerably decidedly deeply enormously entirely especially exceptionally
extremely fabulously flipping frickin fully greatly hella highly hugely incredibly intensely majorly more most
particularly purely quite really remarkably so substantially thoroughly totally tremendously uber unbelievably unusually
utterly very
""".split())
DIMINISHERS = tuple("almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta".split())
