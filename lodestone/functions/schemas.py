"""Schemas of requests, replies, application tables and evaluation rows."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, BOOLEAN, TIME = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()


def of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SOURCE = of(doc_id=STRING, ten_van_ban=STRING, dieu=STRING, khoan=STRING, diem=STRING, chunk_id=STRING, url=STRING, title=STRING)
CITATION = of(n=T.IntegerType(), title=STRING, org=STRING, date=STRING, type=STRING, excerpt=STRING, url=STRING)
WEB_RESULT = of(title=STRING, url=STRING, content=STRING)

CHAT_STATUS = ("completed", "pending_web_review", "rejected")
CHAT_REQUEST = of(query=STRING, thread_id=STRING)
CHAT_RESPONSE = of(thread_id=STRING, status=STRING, answer=STRING, draft_answer=STRING, sources=T.ArrayType(SOURCE), category=STRING, requires_approval=BOOLEAN, model_info=STRING, expanded_query=STRING, error=STRING)
RESUME_REQUEST = of(approved=BOOLEAN, override=T.MapType(STRING, STRING))
PENDING_RESPONSE = of(thread_id=STRING, next_nodes=T.ArrayType(STRING), values=T.MapType(STRING, STRING), requires_approval=BOOLEAN)

USER = of(id=STRING, name=STRING, email=STRING, emailVerified=TIME, image=STRING, createdAt=TIME)
SESSION = of(id=STRING, sessionToken=STRING, userId=STRING, expires=TIME)
CONVERSATION = of(id=STRING, userId=STRING, title=STRING, pinned=BOOLEAN, createdAt=TIME, updatedAt=TIME)
MESSAGE = of(id=STRING, conversationId=STRING, role=STRING, content=STRING, citations=STRING, createdAt=TIME)

EVALUATION = of(id=STRING, question=STRING, gold_answer=STRING, gold_citations=T.ArrayType(of(doc_id=STRING, dieu=T.IntegerType(), khoan=STRING, diem=STRING)))
