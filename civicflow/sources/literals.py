"""Small literal dimension tables.

Their size is fixed by this file (not by data), so joining them with
``F.broadcast`` is always safe. Explanatory and reply texts are our own
wording; only the keys and shapes matter to the jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (keys, mapping and seeded catalogue rows must be exactly these).
# ---------------------------------------------------------------------------
# Law key -> practice area used to query the adviser directory; missing -> Civil.
PRACTICE_MAP = [
    ("domestic_violence", "Criminal"),
    ("posh_act", "Corporate"),
    ("it_act_cyber", "Civil"),
    ("ipc_assault_354", "Criminal"),
    ("ipc_criminal_intimidation_506", "Criminal"),
    ("general", "Civil"),
]
DEFAULT_PRACTICE = "Civil"
FALLBACK_LANG = "english"
KB_DESCRIPTION_TEMPLATE = "Information regarding %s and its application in protecting individual rights."
# Seeded constitution articles: (category, title, description); keywords = lower(title).
ARTICLES = [
    ("Fundamental Right", "Article 14", "Equality before the law."),
    ("Fundamental Right", "Article 15",
     "Prohibition of discrimination on grounds of religion, race, caste, sex or place of birth."),
    ("Fundamental Right", "Article 19", "Protection of certain rights regarding freedom of speech, etc."),
    ("Fundamental Right", "Article 21", "Protection of life and personal liberty."),
]
# Seeded quiz rows: (id, question, options JSON, correct answer, explanation, type).
QUIZ_SEED = [
    (1, "Which article guarantees Equality before the law?",
     '["Article 14", "Article 21", "Article 19", "Article 15"]', "Article 14",
     "Article 14 ensures equality before the law.", "MCQ"),
    (2, "Which act specifically provides protection to women in households?",
     '["IT Act Section 67", "Domestic Violence Act 2005", "POSH Act", "IPC 354"]',
     "Domestic Violence Act 2005",
     "The Domestic Violence Act 2005 protects women from abuse in a domestic setting.", "MCQ"),
]

# ---------------------------------------------------------------------------
# Our own texts. Some (law, language) pairs are deliberately absent: lookups
# fall back to the English text, then to the "general" law.
# ---------------------------------------------------------------------------
LAW_TEXT = [
    ("domestic_violence", "english",
     "Abuse inside a shared home (physical, verbal, emotional or economic) is covered by the 2005 domestic violence law."),
    ("domestic_violence", "hinglish",
     "Ghar ke andar kisi bhi tarah ka abuse 2005 ke domestic violence law mein aata hai."),
    ("domestic_violence", "tanglish",
     "Veetukulla nadakkura ella vidha abuse um 2005 domestic violence law kulla varum."),
    ("posh_act", "english",
     "Sexual harassment at the workplace must be reported to the internal committee the employer has to set up."),
    ("it_act_cyber", "english",
     "Publishing private images or obscene material online is an offence under the information technology law."),
    ("it_act_cyber", "hinglish",
     "Online private photos ya obscene content daalna IT law ke hisaab se offence hai."),
    ("ipc_assault_354", "english",
     "Force used to outrage a woman's modesty is a criminal offence that the police must register."),
    ("ipc_criminal_intimidation_506", "english",
     "Threats of harm and deliberate insults meant to provoke are criminal intimidation offences."),
    ("general", "english",
     "Constitutional rights and the criminal law protect your safety and dignity."),
    ("general", "tamil", "அரசியலமைப்பு உரிமைகளும் சட்டங்களும் உங்கள் பாதுகாப்பை உறுதி செய்கின்றன."),
    ("general", "hindi", "संविधान और कानून आपकी सुरक्षा और सम्मान की रक्षा करते हैं।"),
    ("general", "tanglish", "Constitution um law um unga safety ah protect pannum."),
    ("general", "hinglish", "Constitution aur law aapki safety aur dignity ko protect karte hain."),
]

# (lang, block, variants). "Random" picks use a hash of (conversation, turn).
_EN = {
    "greeting": ["Hello, I am a legal help assistant. What happened?"],
    "empathy_legal": ["I am sorry this is happening to you; the law is on your side.",
                      "Thank you for telling me. What you describe is not acceptable."],
    "empathy_pure": ["I hear you, and what you feel matters.",
                     "It is all right to feel overwhelmed; I am listening."],
    "actions": ["Write down dates and details, keep any messages, and talk to someone you trust.",
                "Keep evidence safe and note the helpline numbers near you."],
    "share_more": ["Would you like to tell me more about what is worrying you?"],
    "follow_up_question": ["How serious is it right now? Do you want to take formal legal action?"],
    "ask_location": ["Which city or area are you in, so I can suggest an adviser nearby?"],
    "lawyer_title": ["Suggested adviser near you:"],
    "lawyer_footer": ["Please contact them for legal representation."],
    "no_lawyer_found": ["No adviser is listed for that place yet; please contact the local police."],
}
_HINGLISH = {
    "greeting": ["Namaste, main legal help assistant hoon. Kya hua?"],
    "empathy_legal": ["Mujhe afsos hai, law aapke saath hai.", "Batane ke liye shukriya, yeh galat hai."],
    "empathy_pure": ["Main sun raha hoon, aapki feeling important hai.", "Pareshan hona normal hai, main yahin hoon."],
    "actions": ["Dates aur details likh lijiye, messages sambhal ke rakhiye.",
                "Saboot safe rakhiye aur helpline number note kijiye."],
    "share_more": ["Kya aap aur batana chahenge?"],
    "follow_up_question": ["Situation kitni serious hai? Kya aap legal action lena chahte hain?"],
    "ask_location": ["Aap kis city mein hain? Main paas ka adviser bataunga."],
    "lawyer_title": ["Aapke paas ke adviser:"],
    "lawyer_footer": ["Legal madad ke liye inse contact kijiye."],
    "no_lawyer_found": ["Is jagah ka adviser abhi list nahi hai; local police se baat kijiye."],
}
REPLY_BLOCKS = ([("english", b, v) for b, v in _EN.items()]
                + [("hinglish", b, v) for b, v in _HINGLISH.items()]
                + [("tamil", "greeting", ["வணக்கம், நான் சட்ட உதவி உதவியாளர். என்ன நடந்தது?"]),
                   ("hindi", "greeting", ["नमस्ते, मैं कानूनी सहायता सहायक हूँ। क्या हुआ?"]),
                   ("tanglish", "greeting", ["Vanakkam, naan legal help assistant. Enna aachu?"])])

LAW_TEXT_SCHEMA = T.StructType([T.StructField("law_key", T.StringType(), False),
                                T.StructField("lang", T.StringType(), False),
                                T.StructField("law_text", T.StringType(), False)])
REPLY_SCHEMA = T.StructType([T.StructField("lang", T.StringType(), False),
                             T.StructField("block", T.StringType(), False),
                             T.StructField("variants", T.ArrayType(T.StringType(), False), False)])
PRACTICE_SCHEMA = T.StructType([T.StructField("law_key", T.StringType(), False),
                                T.StructField("practice_area", T.StringType(), False)])
ARTICLE_SCHEMA = T.StructType([T.StructField("category", T.StringType(), False),
                               T.StructField("title", T.StringType(), False),
                               T.StructField("description", T.StringType(), False)])
QUIZ_SCHEMA = T.StructType([T.StructField("id", T.LongType(), False),
                            T.StructField("question", T.StringType(), False),
                            T.StructField("options", T.StringType(), True),
                            T.StructField("correct_answer", T.StringType(), False),
                            T.StructField("explanation", T.StringType(), True),
                            T.StructField("type", T.StringType(), True)])


def law_text_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LAW_TEXT, LAW_TEXT_SCHEMA)


def reply_block_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPLY_BLOCKS, REPLY_SCHEMA)


def practice_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRACTICE_MAP, PRACTICE_SCHEMA)


def article_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARTICLES, ARTICLE_SCHEMA)


def quiz_seed_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUIZ_SEED, QUIZ_SCHEMA)
