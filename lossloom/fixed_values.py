"""Fixed values.

Word lists, option lists and lookup tables whose content and order decide results. They are data,
stated plainly and kept together; the logic that uses them lives in ``functions`` and ``operators``.
"""

WIDE_VARIETY = "wide_variety"
HARD_PREFIX = "hard:"
VALIDATION_PREFIX = "validation:"

ASSISTANT_QA = "assistant_qa"
CONTEXTUAL_QA = "contextual_qa"
GENERIC_TEXT = "generic_text_task"
STRUCTURED_TEXT = "structured_text_task"
VISUAL_GENERATION = "visual_generation"

NON_CATEGORY_TAGS = ["good", "wide_variety"]

META_INSTRUCTION_MARKERS = [
    "generate one synthetic training sample",
    "you generate",
    "the downstream data generator",
    "use the user's example as a signal",
    "the sample should be broad",
]

CONTEXTUAL_TAGS = [
    "contextual_qa", "contextual_factual_qa", "factual_qa", "contextual_question_answering",
    "open_book_qa", "question_answering", "reading_comprehension", "information_extraction",
]
CONTEXTUAL_BANNED_TAGS = [
    "recommendation", "email_rewriting", "text_rewriting", "meeting_summarization",
    "customer_support_summarization", "recipe_rewriting", "faq_generation",
]
# Tags a forced contextual slot must not be steered away from.
CONTEXTUAL_KEEP_TAGS = ["contextual_qa", "factual_qa", "information_extraction"]

VISUAL_TAGS = [
    "image_editing", "image_generation", "image_prompting", "logo_design",
    "poster_design", "visual_asset_generation", "visual_generation",
]

SHAPE_TAG_ALIASES = {
    ASSISTANT_QA: [
        "assistant_qa", "question_answering", "open_ended_qa", "open_qa", "general_qa", "factual_qa",
    ],
    CONTEXTUAL_QA: [
        "contextual_qa", "contextual_factual_qa", "contextual_question_answering",
        "reading_comprehension", "open_book_qa",
    ],
    VISUAL_GENERATION: [
        "visual_generation", "image_generation", "image_prompting", "image_editing",
        "visual_asset_generation",
    ],
}

# marker -> weight
TEXT_MARKERS = {
    "answer": 1, "question": 1, "context": 1, "classify": 1, "identify": 1, "rewrite": 1,
    "summarize": 1, "extract": 1, "compare": 1, "calculate": 1, "translate": 1, "explain": 1,
    "list": 1, "output": 1,
}
VISUAL_MARKERS = {
    "generate an image": 3, "create an image": 3, "image prompt": 3, "prompt for an image": 3,
    "negative prompt": 3, "photo": 2, "photograph": 2, "illustration": 2, "render": 2,
    "camera angle": 2, "lighting": 2, "composition": 2, "aspect ratio": 2, "logo": 2, "poster": 2,
    "sprite": 2, "visual asset": 2, "image-edit": 2, "image edit": 2, "background removal": 2,
}
STRUCTURED_MARKERS = {
    "classify": 2, "categorize": 2, "rewrite": 2, "extract": 2, "label": 2, "translate": 2,
    "convert": 2, "return json": 2, "json object": 2, "json array": 2, "table": 1,
    "compare the": 1, "calculate": 1, "sort": 1, "rank": 1,
}
CONTEXT_MARKERS = [
    "context:", "passage:", "article:", "source text:", "given the following",
    "based on the following",
]
CONTEXT_MIN_WORDS = 45

QUESTION_STARTS = [
    "what", "when", "where", "who", "whom", "whose", "why", "how", "which", "can", "could",
    "would", "should", "is", "are", "do", "does", "did", "name", "list", "give", "tell",
    "explain", "describe",
]
QUESTION_MARK_WINDOW = 220

# shape -> (input_shape, context_mode, output_shape, answer_style, reasoning_pattern, focus_tag)
SHAPE_DESCRIPTORS = {
    ASSISTANT_QA: (
        "standalone_question", "none", "natural_assistant_answer", "helpful_concise",
        "open_knowledge_or_explanation", "assistant_qa",
    ),
    CONTEXTUAL_QA: (
        "context_plus_question", "required", "grounded_direct_answer", "concise_context_grounded",
        "select_relevant_fact_from_context", "contextual_qa",
    ),
    VISUAL_GENERATION: (
        "creative_visual_request", "visual_constraints", "image_prompt_or_visual_brief",
        "production_ready_visual_spec", "compose_visual_constraints", "visual_generation",
    ),
    STRUCTURED_TEXT: (
        "structured_text_task", "optional", "format_constrained_answer", "task_specific",
        "apply_explicit_operation", "structured_text_task",
    ),
    GENERIC_TEXT: (
        "example_aligned_text", "optional", "task_specific_answer", "example_aligned",
        "follow_user_task", "wide_variety",
    ),
}

HARD_LEVERS = {
    ASSISTANT_QA: [
        "ask for a definition plus one important distinction",
        "require a concise explanation with two or three key facts",
        "ask for a short list where each item needs a brief qualifier",
        "include a common misconception that the answer should avoid",
        "ask a multi-part question that still has one natural assistant-style answer",
    ],
    CONTEXTUAL_QA: [
        "include one answer fact and two plausible distractor facts",
        "use two similar entities that require careful disambiguation",
        "ask about a date, number, or named entity embedded in a short passage",
        "require the answer to be grounded only in the provided context",
    ],
    VISUAL_GENERATION: [
        "combine subject, composition, lighting, and exclusion constraints",
        "require separation of content details from style details",
        "include format or usage constraints such as aspect ratio or asset purpose",
        "ask for a production-ready prompt instead of a vague visual idea",
    ],
    STRUCTURED_TEXT: [
        "combine two constraints that both affect the final answer",
        "require comparison before producing the final output",
        "include a compact output format requirement",
        "add one distractor detail that should not be used",
    ],
}
HARD_LEVERS[GENERIC_TEXT] = HARD_LEVERS[STRUCTURED_TEXT]

# Planner option lists; a hash picks the position, so order matters.
TEXT_DOMAINS = [
    "education or local public services",
    "workplace operations",
    "travel, transport, or scheduling",
    "retail, product, or customer support",
    "science, museum, library, or community program",
    "home planning or everyday logistics",
    "environment, parks, or civic records",
    "technology use in a small organization",
]
VISUAL_DOMAINS = [
    "creative visual production or media design",
    "product photography or visual merchandising",
    "editorial illustration or campaign assets",
    "interface, icon, or visual asset design",
]
INPUT_SHAPES = [
    "short direct task with no separate context",
    "standalone user question with no separate context",
    "context passage plus one focused question",
    "list of items that must be classified, compared, or transformed",
    "notes, schedule, or constraints that require a decision",
    "short paragraph that must be rewritten into a specific style",
    "small table-like facts described in text",
    "dialogue, email, or log excerpt requiring extraction",
    "simple numeric, date, or time facts requiring calculation",
]
VISUAL_INPUT_SHAPES = [
    "brief creative request with subject, setting, and constraints",
    "visual prompt that specifies composition, style, lighting, and mood",
    "image-edit request with source description and desired transformation",
    "asset-generation request with format, background, and usage constraints",
    "scene description with objects, relationships, and visual priorities",
    "style-transfer request with reference style described in words",
]
OUTPUT_SHAPES = [
    "natural assistant answer",
    "one concise sentence",
    "two short sentences",
    "bullet list",
    "numbered steps",
    "compact table in markdown",
    "JSON array or JSON object",
    "rewritten text only",
    "label for each input item",
]
VISUAL_OUTPUT_SHAPES = [
    "final image prompt only",
    "positive prompt plus negative prompt",
    "structured JSON with subject, style, composition, lighting, and exclusions",
    "short production brief",
    "caption plus generation prompt",
    "edit instruction sequence",
]
REASONING = [
    "answer a standalone question using stable general knowledge",
    "single-hop factual lookup",
    "choose the relevant fact while ignoring distractors",
    "compare multiple items before answering",
    "apply all stated constraints",
    "perform simple arithmetic or time reasoning",
    "transform wording while preserving meaning",
    "extract only requested fields",
    "summarize briefly before giving the final answer",
]
VISUAL_REASONING = [
    "preserve the requested subject while varying style and composition",
    "satisfy visual constraints without adding excluded elements",
    "translate abstract mood into concrete visual details",
    "separate required image content from optional style details",
    "produce a usable prompt with clear composition and quality constraints",
]
QA_INPUT_SHAPES = [
    "standalone user question with no separate context",
    "short open-ended question phrased like a normal user request",
    "question-only prompt asking for an explanation, definition, list, or how-to answer",
    "direct user question that does not provide a source passage",
]
QA_OUTPUT_SHAPES = [
    "natural assistant answer",
    "concise explanatory paragraph",
    "short helpful answer with enough detail to be complete",
    "brief bullet list only when the question asks for a list",
]
QA_REASONING = [
    "answer a standalone question using stable general knowledge",
    "explain the core idea without relying on a provided context passage",
    "include the most relevant facts while staying concise",
    "handle a broad user question without turning it into extraction or rewriting",
]
CONTEXTUAL_SHAPE = {
    "input": "context passage plus one focused question",
    "hard_output": "grounded direct answer",
    "forced_output": "one concise sentence",
    "reasoning": "choose the relevant fact while ignoring distractors",
}
DIFFICULTY = {
    "hard": ["medium_hard", "hard", "hard"],
    "validation": ["medium", "medium_hard", "medium_hard"],
    "late": ["medium", "medium_hard", "medium_hard"],
    "middle": ["easy", "medium", "medium_hard"],
    "early": ["easy", "medium", "medium", "medium_hard"],
}
DIFFICULTY_LATE_ROUND = 8
DIFFICULTY_MIDDLE_ROUND = 3

# Blueprint field values.
TAG_HINT_FORCED = "contextual_qa or factual_qa"
TAG_HINT_RARE = "prefer one of these rare known tags if it fits: "
TAG_HINT_OPEN = "API should choose a useful non-wide_variety tag"
NOVELTY = {
    "hard": "create a harder-but-valid sample in the discovered task shape, "
    "using fresh content and avoiding noisy or impossible questions",
    "validation": "train the current shared-validation weakness with fresh content, "
    "same abstract task shape, and different facts, wording, and domain",
    "rare": "explore an underrepresented known category or adjacent new category",
    "open": "create a fresh example-aligned training task with a distinct shape",
    "focused": "train the focused weakness while changing domain, wording, and structure",
}
CONTEXT_POLICY = {
    "forced": "must include a self-contained factual context with one answer fact "
    "and at least one distractor fact",
    "question": "do not include a separate Context block; make the sample a "
    "standalone user question and answer from stable general knowledge",
    "grounded": "include enough input details so the answer is grounded in the sample",
    "optional": "context optional; keep the task self-contained",
}
CONTEXT_POLICY_KEYWORDS = ["context", "facts", "log"]

EXAMPLE_TEMPLATE_MARKERS = [
    "Write the source text here.",
    "Write the question or task here.",
    "Write the source text or input context here.",
    "Write the expected output here.",
]
EXAMPLE_HEADERS = {
    "sample": "sample",
    "instruction": "instruction",
    "instruct": "instruction",
    "question": "instruction",
    "context": "context",
    "input": "context",
    "output": "output",
}

EMPTY_TAG_COUNTS = "No generated tags have been recorded yet."
EMPTY_CATEGORIES = (
    "No known categories yet. Create a clear new snake_case tag for the generated sample."
)
NO_CONSTRAINTS = "No extra constraints."
DEFAULT_CONTEXT_INSTRUCTION = "Use the context to produce the output."
