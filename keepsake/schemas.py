"""Row types of turns, sessions, episodes, facts, questions and result records."""

from __future__ import annotations

from pyspark.sql import types as T

TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("has_answer", T.BooleanType())])
SESSION = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("turns", T.ArrayType(TURN))])

_STRINGS, _FLOATS = T.ArrayType(T.StringType()), T.ArrayType(T.FloatType())


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


EPISODE = _struct(
    id=T.StringType(), ts=T.TimestampNTZType(), session_id=T.StringType(), turn_idx=T.IntegerType(), speaker=T.StringType(), text=T.StringType(),
    entities=_STRINGS, embedding=_FLOATS, tokens=T.IntegerType(), consolidated=T.BooleanType(), access_count=T.IntegerType(), last_access=T.TimestampNTZType(), raw=T.BooleanType(),
)
FACT = _struct(
    id=T.StringType(), entity=T.StringType(), attribute=T.StringType(), value=T.StringType(), valid_from=T.TimestampNTZType(), valid_to=T.TimestampNTZType(), superseded_by=T.StringType(),
    sources=_STRINGS, kind=T.StringType(), speaker=T.StringType(), session_id=T.StringType(), embedding=_FLOATS, tokens=T.IntegerType(), access_count=T.IntegerType(), last_access=T.TimestampNTZType(),
)
EXTRACTION = "struct<episodes:array<struct<turn_idx:int,speaker:string,text:string,entities:array<string>,date:string>>,facts:array<struct<turn_idx:int,entity:string,attribute:string,custom_attribute:string,value:string,kind:string,speaker:string,valid_from:string>>>"
#: Budgets of a memory: tokens stored, tokens read, tokens of verbatim turns.
STORE_TOKENS, READ_TOKENS, RAW_TOKENS = 1_000_000_000, 2000, 0

# The closed list of attributes that extraction may name.
ATTRIBUTES = (
    "name", "location", "employer", "occupation", "status", "count", "frequency", "duration", "schedule", "personal_best", "amount", "price", "model",
    "method", "setting", "preference", "favorite", "dislike", "allergy", "health", "goal", "relationship", "date", "contact", "other",
)
# Words that carry no content for an embedding.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "so", "of", "to", "in", "on", "at", "for", "with", "by", "from", "as", "is", "are", "was", "were",
    "be", "been", "being", "am", "i", "me", "my", "we", "our", "you", "your", "he", "she", "it", "its", "they", "them", "this", "that", "these",
    "those", "there", "here", "have", "has", "had", "do", "does", "did", "not", "no", "yes", "just", "very", "really", "also", "about", "into",
    "over", "after", "before", "while", "when", "where", "what", "which", "who", "whom", "how", "why", "can", "could", "would", "should", "will",
    "shall", "may", "might", "must", "than", "then", "too",
)
# Words that carry no content for an entailment.
ENTAILMENT_STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "so", "of", "to", "in", "on", "at", "for", "with", "by", "from", "as", "is", "are", "was",
    "were", "be", "been", "being", "i", "me", "my", "we", "our", "you", "your", "he", "she", "it", "they", "them", "this", "that", "these", "those",
    "there", "here", "have", "has", "had", "do", "does", "did", "not", "no", "yes", "just", "very", "really", "also", "about", "into", "over",
    "after", "before", "while", "when", "where", "what", "which", "who", "whom", "how", "why", "can", "could", "would", "should", "will", "shall",
    "may", "might", "must",
)
# Words dropped when a question is rewritten.
QUESTION_WORDS = (
    "what", "which", "where", "when", "how", "many", "much", "did", "do", "does", "is", "are", "was", "were", "the", "a", "an", "my", "i", "me",
    "you", "your", "of", "to", "in", "on", "at", "for", "about", "tell", "remember", "have", "has", "had", "that", "this", "it", "and", "or",
)
# Capitalised words that aren't entities.
NOT_ENTITIES = (
    "I", "The", "A", "An", "My", "Me", "We", "It", "This", "That", "You", "He", "She", "They", "What", "How", "When", "Where", "Why", "Yes", "No",
    "Ok", "Okay", "Hi", "Hello", "Thanks", "Thank", "Please", "Also", "And", "But", "So", "If", "In", "On", "At", "For",
)
