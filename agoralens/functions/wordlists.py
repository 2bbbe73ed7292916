"""Word lists and community groups.

Fixed values: results depend on every entry.
"""

LABELS = ["negative", "neutral", "positive"]
LABEL_IDS = {"negative": 0, "neutral": 1, "positive": 2}

# --- Weak labelling: matched as substrings of the lower-cased raw text -------

POSITIVE_STRONG = [
    "amazing", "excellent", "fantastic", "wonderful", "brilliant",
    "outstanding", "perfect", "exceptional", "incredible", "awesome",
]
POSITIVE_MODERATE = [
    "good", "great", "nice", "happy", "glad", "pleased", "enjoy",
    "helpful", "appreciate", "thanks", "thank", "interesting",
]
NEGATIVE_STRONG = [
    "horrible", "terrible", "awful", "disgusting", "pathetic",
    "disaster", "hate", "worst", "garbage", "useless",
]
NEGATIVE_MODERATE = [
    "bad", "poor", "disappointing", "annoying", "frustrated",
    "difficult", "wrong", "problem", "issues", "unfortunately",
]

COMMUNITY_PRIORS = {
    "positive": ["UpliftingNews", "MadeMeSmile", "wholesome", "happy", "aww"],
    "negative": ["rant", "complaints", "unpopularopinion", "TrueOffMyChest"],
    "neutral": ["AskReddit", "explainlikeimfive", "NoStupidQuestions"],
}

# --- Estimate while collecting: matched as whole whitespace tokens ----------

ESTIMATE_POSITIVE_STRONG = [
    "amazing", "excellent", "fantastic", "wonderful", "brilliant",
    "perfect", "incredible", "outstanding", "delighted", "blessed",
]
ESTIMATE_POSITIVE_MODERATE = [
    "good", "nice", "happy", "glad", "pleased", "thanks",
    "helpful", "appreciate", "enjoyed", "like", "cool",
]
ESTIMATE_NEGATIVE_STRONG = [
    "hate", "terrible", "awful", "horrible", "disgusting", "furious",
    "angry", "disappointed", "frustrating", "worst", "pathetic",
]
ESTIMATE_NEGATIVE_MODERATE = [
    "bad", "poor", "annoying", "difficult", "upset", "worried",
    "concerned", "tired", "stressed", "disagree", "unfortunately",
]

# Communities visited by the balanced collection, in order of visit.
COLLECTION_GROUPS = {
    "negative": [
        "unpopularopinion", "rant", "TrueOffMyChest", "AmItheAsshole",
        "relationship_advice", "complaints", "mildlyinfuriating",
        "ChoosingBeggars", "tifu", "pettyrevenge", "BestofRedditorUpdates",
        "JUSTNOMIL", "raisedbynarcissists", "talesfromretail",
        "entitledparents", "careerguidance",
    ],
    "neutral": [
        "AskReddit", "explainlikeimfive", "NoStupidQuestions",
        "todayilearned", "OutOfTheLoop", "movies", "gaming",
    ],
    "positive": [
        "UpliftingNews", "MadeMeSmile", "wholesome", "happy",
        "CasualConversation", "aww", "CongratsLikeImFive",
    ],
}
COLLECTION_LISTINGS = {
    "negative": ["controversial", "new", "hot"],
    "neutral": ["hot", "new", "top"],
    "positive": ["hot", "new", "top"],
}

# Bulk collection: rows wanted from each community, listing priority.
BULK_LIMIT = 500
BULK_LISTINGS = ["hot", "top", "new", "controversial"]

REMOVED_MARKS = ["[deleted]", "[removed]"]

# --- Stop words --------------------------------------------------------------

# The NLTK list for English; entries with an apostrophe cannot occur after
# cleaning and are left out.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before
after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now
d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn
needn shan shouldn wasn weren won wouldn
""".split()
SENTIMENT_STOP_WORDS = ["not", "no", "nor", "neither", "never", "none"]
STOP_WORDS = [w for w in ENGLISH_STOP_WORDS if w not in SENTIMENT_STOP_WORDS]

# The English stop words of scikit-learn (sklearn.feature_extraction.text).
TFIDF_STOP_WORDS = """
a about above across after afterwards again against all almost alone along
already also although always am among amongst amoungst amount an and another any
anyhow anyone anything anyway anywhere are around as at back be became because
become becomes becoming been before beforehand behind being below beside besides
between beyond bill both bottom but by call can cannot cant co con could couldnt
cry de describe detail do done down due during each eg eight either eleven else
elsewhere empty enough etc even ever every everyone everything everywhere except
few fifteen fifty fill find fire first five for former formerly forty found four
from front full further get give go had has hasnt have he hence her here
hereafter hereby herein hereupon hers herself him himself his how however
hundred i ie if in inc indeed interest into is it its itself keep last latter
latterly least less ltd made many may me meanwhile might mill mine more moreover
most mostly move much must my myself name namely neither never nevertheless next
nine no nobody none noone nor not nothing now nowhere of off often on once one
only onto or other others otherwise our ours ourselves out over own part per
perhaps please put rather re same see seem seemed seeming seems serious several
she should show side since sincere six sixty so some somehow someone something
sometime sometimes somewhere still such system take ten than that the their them
themselves then thence there thereafter thereby therefore therein thereupon
these they thick thin third this those though three through throughout thru thus
to together too top toward towards twelve twenty two un under until up upon us
very via was we well were what whatever when whence whenever where whereafter
whereas whereby wherein whereupon wherever whether which while whither who
whoever whole whom whose why will with within without would yet you your yours
yourself yourselves
""".split()
