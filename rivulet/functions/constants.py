"""Fixed values that results depend on.

FIXED VALUES: these lists and tables must stay exactly as written (contents
and order) for results to agree with the behaviour being reproduced; the
order of CONTENT_TYPES, AGE_BUCKETS and DEVICE_BUCKETS fixes feature positions.
"""

# FIXED VALUES — enumerations
CONTENT_TYPES = ["video", "movie", "article", "product", "music", "podcast", "course", "game"]
INTERACTION_TYPES = ["view", "like", "dislike", "share", "click", "purchase", "bookmark", "comment"]

# FIXED VALUES — one-hot buckets of the ranking features
AGE_BUCKETS = ["18-24", "25-34", "35-44", "45-54", "55+"]
DEVICE_BUCKETS = ["web", "mobile", "tablet", "tv"]

# FIXED VALUES — profile defaults for users without a row
DEFAULT_COUNTRY = "US"
DEFAULT_DEVICE = "web"
DEFAULT_AGE_GROUP = "25-34"

# FIXED VALUES — confidence weight per interaction type (unknown type: 1.0;
# a view with dwell > 60 s weighs 3.0; negative weights floor at 0)
CONFIDENCE_WEIGHTS = {
    "purchase": 4.0, "like": 4.0, "bookmark": 4.0,
    "view": 2.0, "click": 1.0, "share": 1.0,
    "dislike": -1.0, "comment": 1.5,
}

# FIXED VALUES — interaction types that count as positives / session events
POSITIVE_TYPES = ["view", "like", "purchase", "bookmark"]
STRONG_POSITIVE_TYPES = ["like", "purchase", "bookmark"]
SESSION_TYPES = ["view", "click", "like"]
EDUCATIONAL_TYPES = ["course", "article", "video", "podcast"]

# FIXED VALUES — experiments
EXPERIMENTS = [
    # experiment_id, name, description, traffic_split, control_arm, treatment_arm, status
    ("recommendation_algorithm_v1", "ML vs Popularity Algorithm Test",
     "Comparing XGBoost ML recommendations vs popularity-based recommendations",
     0.5, "popularity_based", "xgboost_ml", "active"),
]
DEFAULT_EXPERIMENT = "recommendation_algorithm_v1"

# FIXED VALUES — blend weights of the recommender (model, factors, popularity)
BLEND_WEIGHTS = (0.5, 0.35, 0.15)

# FIXED VALUES — metric histogram bucket bounds (seconds)
LATENCY_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0]
RETRAIN_BUCKETS = [1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]

# FIXED VALUES — standard normal CDF polynomial (Abramowitz & Stegun 26.2.17)
NORMAL_CDF_P = 0.2316419
NORMAL_CDF_B = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]

# FIXED VALUES — ML-1M genre → category, age code → age group
GENRE_CATEGORY = {
    "Action": "Action", "Adventure": "Adventure", "Animation": "Animation",
    "Children's": "Family", "Comedy": "Comedy", "Crime": "Crime",
    "Documentary": "Documentary", "Drama": "Drama", "Fantasy": "Fantasy",
    "Film-Noir": "Thriller", "Horror": "Horror", "Musical": "Music",
    "Mystery": "Mystery", "Romance": "Romance", "Sci-Fi": "Sci-Fi",
    "Thriller": "Thriller", "War": "Drama", "Western": "Western",
}
AGE_GROUP = {"1": "18-24", "18": "18-24", "25": "25-34", "35": "35-44",
             "45": "45-54", "50": "55-64", "56": "65+"}

# FIXED VALUES — English stop words: Spark ML's default English list
# (StopWordsRemover.loadDefaultStopWords("english")), kept here so that the
# Spark plan and the SQL oracle use the same table.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or because
as until while of at by for with about against between into through during before after above below to from
up down in out on off over under again further then once here there when where why how all any both each few
more most other some such no nor not only own same so than too very s t can will just don should now i'll
you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're
i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't
wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's
when's where's who's why's would""".split()
