"""Schemas of the collections."""

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType())}


def _schema(columns: str) -> T.StructType:
    """A flat schema; unlike DDL it needs no session."""
    return T.StructType([T.StructField(c.split()[0], _TYPES[c.split()[1]]) for c in columns.split(", ")])



DOCUMENTS = _schema("id string, content string, metadata string, created_at timestamp, _rev int, content_tokens string, embedding_status string, chunk_length int, embedding array<float>")
VECTORS = _schema("id string, content string, metadata string, embedding array<float>, embedding_status string, created_at timestamp, _rev int")
MEDIA = _schema("id string, content string, metadata string, created_at timestamp, _rev int, text_embedding array<float>, image_embedding array<float>, embedding_status string")
ENTITIES = _schema("entity_id string, entity_name string, metadata string, embedding array<float>, embedding_status string, created_at timestamp, updated_at timestamp")
QUADS = _schema("subject string, predicate string, object string, created_at bigint")
REST_DOCUMENTS = _schema("id string, collection_name string, data string, embedding array<float>, content string, content_tokens string, created_at timestamp, updated_at timestamp")
ATTACHMENTS = _schema("file_id string, relative_path string, absolute_path string, file_size bigint, mime_type string, md5 string, metadata string, created_at timestamp, updated_at timestamp")
TRIPLE = "array<struct<subject:string,predicate:string,object:string>>"
#: DDL, for from_json.
GRAPH = "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,relation:string,description:string>>"
KEYWORDS = "low_level array<string>, high_level array<string>"
