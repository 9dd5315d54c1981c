"""Explicit schemas of the stored and derived tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()

USERS = _struct(user_id=_S, display_name=_S, created_at=_TS)
REGISTRY = _struct(doc_id=_S, filename=_S, file_type=_S, chunk_count=_I,
                   user_id=_S, file_hash=_S, uploaded_at=_TS)
DOCUMENT_COLLECTIONS = _struct(doc_id=_S, collection=_S)
CHAT_SESSIONS = _struct(session_id=_S, user_id=_S, created_at=_TS, last_access=_TS)
CHAT_MESSAGES = _struct(id=_L, session_id=_S, role=_S, content=_S, created_at=_TS)

CHUNKS = _struct(chunk_id=_S, doc_id=_S, chunk_index=_I, page=_I, source_file=_S,
                 content=_S, collections=T.ArrayType(_S),
                 extra=T.MapType(_S, _S))
VECTORS = _struct(chunk_id=_S, doc_id=_S, embedding=T.ArrayType(T.FloatType()),
                  norm=T.DoubleType())
QUERIES = _struct(query_id=_S, question=_S, top_k=_I, doc_ids=T.ArrayType(_S),
                  collection=_S, session_id=_S, user_id=_S)

TABLES = {
    "users": USERS,
    "registry": REGISTRY,
    "document_collections": DOCUMENT_COLLECTIONS,
    "chat_sessions": CHAT_SESSIONS,
    "chat_messages": CHAT_MESSAGES,
}
