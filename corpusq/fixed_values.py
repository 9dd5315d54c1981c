"""Word lists, templates, limits and patterns that results depend on.

Everything in this module is data. The rules that use it live elsewhere.
"""

# --- Fixed values: file types accepted for ingestion -------------------------
SUPPORTED_SUFFIXES = [
    ".pdf", ".txt", ".md", ".html", ".htm",
    ".docx", ".xlsx", ".xls", ".pptx", ".ppt",
]

# --- Fixed values: defaults and limits ---------------------------------------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
CHUNK_SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
DEFAULT_TOP_K = 4
MAX_TOP_K = 20
MAX_QUESTION_CHARS = 2000
RERANK_TOP_N = 4
RERANK_OVERFETCH = 3
POST_FILTER_OVERFETCH = 5
BM25_WEIGHT = 0.5
MEMORY_MAX_MESSAGES = 20
MEMORY_TTL_SECONDS = 3600
DEFAULT_USER = "admin"
DEFAULT_COLLECTION = "other"
MAX_UPLOAD_MB = 50
USER_ID_PATTERN = "^[a-zA-Z0-9_-]+$"
MAX_USER_ID_CHARS = 50
MAX_DISPLAY_NAME_CHARS = 100
LABEL_MAX_CHARS = 50
EXCERPT_CHUNKS = 3
EXCERPT_CHARS = 1500
SOURCE_SNIPPET_CHARS = 500
SENTENCE_MARKS = [". ", ".\n", "! ", "? "]
CONTEXT_DIVIDER = "\n\n---\n\n"
ROLES = ["human", "ai"]

# --- Fixed values: column length caps, table -> column -> characters ----------
COLUMN_CAPS = {
    "users": {"user_id": 50, "display_name": 100},
    "registry": {"doc_id": 32, "filename": 500, "file_type": 20,
                 "user_id": 50, "file_hash": 64},
    "document_collections": {"doc_id": 32, "collection": 200},
    "chat_sessions": {"session_id": 100, "user_id": 50},
    "chat_messages": {"session_id": 100, "role": 10},
}

# --- Fixed values: published ranking constants --------------------------------
BM25_K1 = 1.5          # Robertson & Zaragoza 2009
BM25_B = 0.75
RRF_CONSTANT = 60      # Cormack, Clarke & Buettcher 2009

# --- Fixed values: status codes and messages ----------------------------------
UNSUPPORTED_TYPE = 400
NOT_FOUND = 404
DUPLICATE = 409
TOO_LARGE = 413
INVALID = 422
UPLOAD_MESSAGE = "Document uploaded and indexed successfully"
SUGGESTED_MESSAGE = ". AI suggested: "
NO_COLLECTIONS_TEXT = "(none)"

# --- Fixed values: prompt templates -------------------------------------------
ANSWER_PROMPT = """\
You are a helpful assistant that answers questions based on the provided context.
Use ONLY the context below to answer the question. If the context does not contain
enough information to answer, say so clearly — do not make up information.

Context:
{context}
"""

CLASSIFY_PROMPT = """\
You are a document classifier. Analyze the document excerpt below and classify it using the provided taxonomy.

## Taxonomy (Primary Category → Domains)
{taxonomy_text}

## Existing custom collections in the system
{existing_collections}

## Rules
1. Pick exactly 1 primary category from the taxonomy above.
2. Pick 1-2 domains from that category (or from a second category if the document spans topics).
3. Return ONLY a JSON array of collection names, e.g. ["legal-compliance", "contracts-agreements"]
4. Use only lowercase, hyphen-separated names.
5. You may include ONE custom collection name if the document clearly doesn't fit the taxonomy.

## Document excerpt
{content}

JSON array:"""

# --- Fixed values: taxonomy, (primary, domain, sub-domains) -----------------------
TAXONOMY = [
    ("legal-compliance", "contracts-agreements",
     ["employment-contract", "sales-contract", "service-agreement", "nda", "sla",
      "terms-conditions"]),
    ("legal-compliance", "regulation-policy",
     ["regulatory-guidance", "compliance-policy", "standards-norms",
      "government-regulation"]),
    ("legal-compliance", "litigation-disputes",
     ["court-decision", "claims-pleadings", "evidence-exhibits", "settlement"]),
    ("legal-compliance", "intellectual-property",
     ["patent", "trademark", "copyright", "licensing-agreement"]),
    ("legal-compliance", "legal-opinion",
     ["legal-memo", "attorney-letter", "due-diligence-report"]),
    ("finance-accounting", "banking",
     ["bank-statement", "payment-confirmation", "loan-documents", "credit-card-statement"]),
    ("finance-accounting", "tax",
     ["tax-return", "tax-notice", "vat-gst-documents", "tax-certificate"]),
    ("finance-accounting", "corporate-finance",
     ["financial-statements", "audit-report", "budget-reports", "cash-flow-reports",
      "management-reports"]),
    ("finance-accounting", "investment-markets",
     ["investment-research", "portfolio-statement", "prospectus", "trading-statement"]),
    ("finance-accounting", "billing",
     ["invoice", "receipt", "expense-report", "purchase-reconciliation"]),
    ("business-operations", "procurement-supply",
     ["purchase-order", "quotation", "delivery-note", "vendor-contract"]),
    ("business-operations", "sales-customer",
     ["proposal", "statement-of-work", "customer-onboarding", "support-summary"]),
    ("business-operations", "project-process",
     ["project-plan", "meeting-minutes", "process-documentation", "kpi-reports"]),
    ("business-operations", "risk-governance",
     ["risk-assessment", "internal-audit", "board-materials", "policy-pack"]),
    ("technical-engineering", "software-engineering",
     ["api-documentation", "architecture-design", "runbook", "security-report",
      "release-notes"]),
    ("technical-engineering", "it-infrastructure",
     ["network-diagram", "system-specification", "incident-postmortem", "sop"]),
    ("technical-engineering", "mechanical-manufacturing",
     ["cad-drawing", "process-sheet", "cam-setup", "quality-report",
      "material-specification"]),
    ("technical-engineering", "electrical-electronics",
     ["circuit-diagram", "test-report", "compliance-certificate", "component-datasheet"]),
    ("medical-healthcare", "clinical-documents",
     ["lab-results", "imaging-reports", "discharge-summary", "prescription"]),
    ("medical-healthcare", "insurance-claims",
     ["claim-form", "coverage-statement", "billing-statement"]),
    ("medical-healthcare", "medical-research",
     ["clinical-protocol", "investigator-brochure", "safety-report"]),
    ("government-administrative", "immigration-residency",
     ["visa-documents", "residence-permit", "work-permit", "appointment-notice"]),
    ("government-administrative", "public-services",
     ["official-notice", "application-form", "certificate", "registration-document"]),
    ("government-administrative", "tax-social-security",
     ["tax-office-letters", "social-insurance-records", "benefits-notice"]),
    ("hr-personal", "employment",
     ["resume-cv", "offer-letter", "employment-contract", "performance-review"]),
    ("hr-personal", "payroll",
     ["payslip", "bonus-statement", "annual-income-statement"]),
    ("hr-personal", "personal-records",
     ["identity-documents", "utility-bills", "insurance-policy", "education-certificate"]),
    ("marketing-media", "brand-content",
     ["brochure", "press-release", "product-sheet", "pitch-deck"]),
    ("marketing-media", "market-intelligence",
     ["market-report", "competitor-analysis", "customer-survey"]),
    ("education-research", "teaching-materials",
     ["lecture-notes", "slides", "assignments", "course-handbook"]),
    ("education-research", "academic-administration",
     ["transcript", "degree-certificate", "enrollment-letter"]),
    ("research-scientific", "fundamental-science",
     ["physics", "mathematics", "chemistry", "astronomy", "geoscience"]),
    ("research-scientific", "computer-science-ai",
     ["machine-learning", "nlp", "computer-vision", "distributed-systems", "cybersecurity",
      "software-engineering-research"]),
    ("research-scientific", "engineering-research",
     ["materials-science", "control-systems", "aerospace-engineering", "robotics",
      "manufacturing-cam-research"]),
    ("research-scientific", "life-science-biomedical",
     ["molecular-biology", "neuroscience", "genomics", "public-health",
      "clinical-trials-research"]),
    ("research-scientific", "environmental-energy",
     ["climate-research", "renewable-energy", "sustainability-studies",
      "environmental-engineering"]),
    ("research-scientific", "social-science-economics",
     ["economics-research", "finance-research", "psychology", "policy-research",
      "legal-research"]),
    ("research-scientific", "interdisciplinary-science",
     ["complex-systems", "computational-social-science", "history-of-science",
      "philosophy-of-science"]),
    ("other", "unclassified",
     ["low-ocr-quality", "mixed-content", "unreadable-documents"]),
]
