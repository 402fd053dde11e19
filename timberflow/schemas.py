"""Table schemas: column names with their Spark types, in storage order."""

EVENTS = {
    "id": "string",
    "timestamp": "timestamp",
    "ts_nanos": "int",
    "level": "string",
    "source": "string",
    "message": "string",
    "fields": "map<string,string>",
    "fingerprint": "string",
    "input": "string",
    "line": "bigint",
    "ingested_at": "timestamp",
}

INCIDENTS = {
    "id": "string",
    "rule_id": "string",
    "title": "string",
    "status": "string",
    "severity": "string",
    "group": "string",
    "fingerprint": "string",
    "first_seen": "timestamp",
    "last_seen": "timestamp",
    "opened_at": "timestamp",
    "updated_at": "timestamp",
    "resolved_at": "timestamp",
    "count": "bigint",
    "event_ids": "array<string>",
    "labels": "map<string,string>",
    "history": "array<struct<at:timestamp,`from`:string,`to`:string,reason:string>>",
}

REJECTED = {"input": "string", "line": "bigint", "reason": "string", "raw": "string"}

MANIFEST = {"path": "string", "size": "bigint", "sha256": "string"}

AUDIT = {
    "sequence": "bigint",
    "time": "timestamp",
    "action": "string",
    "subject": "string",
    "details": "map<string,string>",
    "previous": "string",
    "digest": "string",
}


def ddl(schema: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in schema.items())
