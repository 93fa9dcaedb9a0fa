"""Types of the document model: documents, fields with provenance, candidates."""

HIGH, MEDIUM, LOW, UNKNOWN = "high", "medium", "low", "unknown"
VERBATIM, DERIVED, INTERPRETED, NOT_FOUND = "verbatim", "derived", "interpreted", "not_found"

WORD = "struct<text:string,x0:double,y0:double,x1:double,y1:double>"
DOCUMENT = f"doc_id long, path string, pages array<string>, ocr_used boolean, cover_spans array<struct<text:string,size:double,page:int>>, words array<array<{WORD}>>"


def candidate(kind: str) -> str:
    return f"struct<path:string,value:{kind},page:int,snippet:string>"


def field(kind: str) -> str:
    """A value with its provenance; not found is a null value with method not_found."""
    return f"struct<value:{kind},confidence:string,method:string,source_page:int,source_snippet:string,notes:string,paths:array<{candidate(kind)}>,review_required:boolean>"


#: Kinds of the extracted values.
KINDS = {
    "price": "bigint", "capRate": "double", "noi": "bigint", "buildingSf": "bigint", "lotAcres": "double", "yearBuilt": "int", "parkingCount": "int",
    "driveThru": "boolean", "leaseType": "string", "commenced": "string", "expires": "string", "currentRent": "bigint", "escalationPct": "double",
    "trafficCount": "bigint", "tenant": "string", "offeringFirm": "string", "population_5mi": "bigint",
    "address": "struct<address:string,city:string,state:string,zip:string>",
}
