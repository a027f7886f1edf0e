"""Fixed values.

Everything in this module must equal the published behaviour for results to be
right: names of tools, word lists, labels, patterns and numeric constants. Logic
lives elsewhere.
"""

# --- retrieval constants -------------------------------------------------
TOP_K = 5
DENSE_K = 20
BM25_K = 20
RRF_K = 60
BM25_K1 = 1.5
BM25_B = 0.75
DENSE_SCORE_WEIGHT = 0.03
MIN_DENSE_SIM = 0.35
RERANK_CANDIDATES = 20
TOKEN_PATTERN = r"[a-zA-Z0-9]+|[一-鿿]"

# --- category aliases ----------------------------------------------------
CATEGORY_ALIASES = {
    "Electronics": ["电子产品", "数码", "电子配件"],
    "Home & Kitchen": ["家居", "厨房", "家用电器"],
    "Cell Phones": ["手机", "手机配件"],
    "Computers": ["电脑", "计算机", "电脑配件"],
    "Headphones": ["耳机", "蓝牙耳机"],
}

POLICY_ALIASES = {
    "return": "退换货",
    "warranty": "售后保修",
    "shipping": "物流",
    "invoice": "发票",
    "refund": "退款",
    "退换货": "退换货",
    "保修": "售后保修",
    "售后保修": "售后保修",
    "物流": "物流",
    "发票": "发票",
    "退款": "退款",
}

# --- tools ---------------------------------------------------------------
IDENTITY_GUARDED_TOOLS = [
    "get_order",
    "check_return_eligibility",
    "create_return_request",
    "cancel_pending_order",
    "modify_pending_order_address",
    "modify_pending_order_items",
    "modify_pending_order_payment",
    "modify_user_address",
    "return_delivered_order_items",
    "exchange_delivered_order_items",
]
RETAIL_WRITE_TOOLS = [
    "cancel_pending_order",
    "exchange_delivered_order_items",
    "modify_pending_order_address",
    "modify_pending_order_items",
    "modify_pending_order_payment",
    "modify_user_address",
    "return_delivered_order_items",
]
PROBE_WRITE_TOOLS = RETAIL_WRITE_TOOLS + ["create_return_request"]
AUTH_TOOLS = ["find_user_id_by_email", "find_user_id_by_name_zip"]
CANCEL_REASONS = ["no longer needed", "ordered by mistake"]
VERIFICATION_CODE_PATTERN = r"[0-9]{6}"

_ADDRESS = {
    "address1": "string",
    "address2": "string",
    "city": "string",
    "state": "string",
    "country": "string",
    "zip": "string",
}
_ORDER_CALLER = {"order_id": "string", "user_id": "string", "verification_code": "string"}

# Required and optional parameters of each tool, with their JSON types.
TOOL_PARAMETERS = {
    "search_catalog": {
        "required": {"query": "string"},
        "optional": {"top_k": "integer", "category": "string|null", "max_price": "number|null"},
    },
    "get_product": {"required": {"product_id": "string"}},
    "compare_products": {"required": {"product_ids": "array<string>"}},
    "get_policy": {"required": {"policy_type": "string"}},
    "get_order": {"required": _ORDER_CALLER},
    "check_return_eligibility": {"required": _ORDER_CALLER},
    "create_return_request": {"required": {**_ORDER_CALLER, "confirmed": "boolean"}},
    "cancel_pending_order": {
        "required": {**_ORDER_CALLER, "reason": "string", "confirmed": "boolean"},
    },
    "modify_pending_order_address": {
        "required": {**_ORDER_CALLER, **_ADDRESS, "confirmed": "boolean"},
    },
    "modify_pending_order_items": {
        "required": {
            **_ORDER_CALLER,
            "item_ids": "array<string>",
            "new_item_ids": "array<string>",
            "payment_method_id": "string",
            "confirmed": "boolean",
        },
    },
    "modify_pending_order_payment": {
        "required": {**_ORDER_CALLER, "payment_method_id": "string", "confirmed": "boolean"},
    },
    "modify_user_address": {
        "required": {
            "user_id": "string",
            "verification_code": "string",
            **_ADDRESS,
            "confirmed": "boolean",
        },
    },
    "return_delivered_order_items": {
        "required": {
            **_ORDER_CALLER,
            "item_ids": "array<string>",
            "payment_method_id": "string",
            "confirmed": "boolean",
        },
    },
    "exchange_delivered_order_items": {
        "required": {
            **_ORDER_CALLER,
            "item_ids": "array<string>",
            "new_item_ids": "array<string>",
            "payment_method_id": "string",
            "confirmed": "boolean",
        },
    },
    "escalate_to_human": {
        "required": {"user_id": "string", "reason": "string"},
        "optional": {"order_id": "string|null"},
    },
}
# Patterns and enumerations attached to parameters (keyed by tool or for every tool).
PARAMETER_PATTERNS = {"product_id": r"P[0-9]{5}", "verification_code": r"[0-9]{6}"}
PARAMETER_ENUMS = {
    ("get_policy", "policy_type"): ["return", "warranty", "shipping", "invoice", "refund"],
    ("cancel_pending_order", "reason"): CANCEL_REASONS,
}
PATTERN_TOOLS = {"product_id": ["get_product"], "verification_code": IDENTITY_GUARDED_TOOLS}

# --- freshness -----------------------------------------------------------
PRICE_CLAIM_PATTERN = r"[0-9]+(?:\.[0-9]+)?\s*元|价格|售价|多少钱|优惠|折扣"
INVENTORY_TERMS = ["现货", "预售", "缺货", "售罄", "库存", "补货", "有货", "无货", "发货"]
POLICY_TERMS = ["退货", "换货", "退款", "保修", "维修", "质保", "发票", "运费", "配送", "七天"]
FRESHNESS_MAX_AGE_DAYS = 30

# --- answer facts --------------------------------------------------------
ID_FACT_PATTERN = r"(?i)\b(?:P[0-9]{5}|O[0-9]{6}|POL[0-9]{3})\b"
ISO_DATE_PATTERN = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
ZH_DATE_PATTERN = r"(?<![0-9])[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日"
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
EN_DATE_PATTERN = (
    r"(?i)\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|"
    r"Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|"
    r"Dec(?:ember)?)\s+[0-9]{1,2},\s+[0-9]{4}\b"
)
NUMERIC_FACT_PATTERN = (
    r"(?i)(?<![A-Za-z0-9])[0-9]+(?:\.[0-9]+)?\s*"
    r"(?:元|个工作日|工作日|天|日|小时|分钟|件|个|%|mAh|Pa|kg|g|ml|pounds?|inches?)"
)
STATUS_TERMS = [
    "pending", "processed", "delivered", "cancelled", "requested", "out_of_stock",
    "已交付", "已送达", "待处理", "处理中", "已取消", "缺货", "有货", "可退货", "不可退货",
    "符合退货条件", "不符合退货条件", "退货申请已提交", "已成功提交", "已申请退货", "已停产", "未停产",
]
FACT_ALIASES = {
    "已送达": "delivered", "已交付": "delivered", "待处理": "pending", "处理中": "processed",
    "已取消": "cancelled", "缺货": "out_of_stock", "有货": "available", "可退货": "true",
    "符合退货条件": "true", "不可退货": "false", "不符合退货条件": "false",
    "退货申请已提交": "requested", "已成功提交": "requested", "已申请退货": "requested",
}
VALUE_ALIASES = {
    "delivered": ["已送达", "已交付", "已签收"],
    "pending": ["待处理", "待付款"],
    "processed": ["处理中", "已处理"],
    "cancelled": ["已取消"],
    "requested": ["已提交退货", "退货申请已提交", "已成功提交", "已申请退货"],
    "true": ["符合退货条件", "可以退货", "可退货"],
    "false": ["不符合退货条件", "不能退货", "不可退货"],
}
STATUS_VOCABULARY = {
    "order.status": {
        "pending": ["pending", "待处理"],
        "processed": ["processed", "处理中", "已处理"],
        "delivered": ["delivered", "已送达", "已交付"],
        "cancelled": ["cancelled", "已取消"],
    },
    "order.inventory_status": {"available": ["有货"], "out_of_stock": ["out_of_stock", "缺货"]},
    "return.return_status": {
        "requested": ["requested", "退货申请已提交", "已成功提交", "已申请退货"],
        "already_requested": ["already_requested", "已提交过退货"],
    },
}
BOOLEAN_PHRASES = [
    ("已停产", "product.discontinued", "true"),
    ("未停产", "product.discontinued", "false"),
    ("不符合退货条件", "return.eligible", "false"),
    ("不可退货", "return.eligible", "false"),
    ("符合退货条件", "return.eligible", "true"),
    ("可退货", "return.eligible", "true"),
]
DURATION_PATTERN = r"[0-9]+(?:\.[0-9]+)?\s*(?:个工作日|工作日|天|日|小时|分钟)"
BUDGET_PATTERNS = [
    r"(?:预算|上限)[^0-9]{0,8}([0-9]+(?:\.[0-9]+)?)\s*元?",
    r"(?:不超过|不高于|以内|最多)[^0-9]{0,8}([0-9]+(?:\.[0-9]+)?)\s*元",
    r"(?:只能花|只能用|最多花)[^0-9]{0,8}([0-9]+(?:\.[0-9]+)?)\s*元",
    r"([0-9]+(?:\.[0-9]+)?)\s*元(?:以内|以下|封顶)",
]

# --- evidence fields -----------------------------------------------------
PRODUCT_EVIDENCE_FIELDS = [
    "product_id", "title", "category", "price", "inventory", "discontinued", "updated_at",
]
ORDER_EVIDENCE_FIELDS = [
    "order_id", "product_id", "status", "ordered_at", "delivered_at", "opened",
    "quality_issue", "inventory_status", "return_status", "version",
]
RETURN_EVIDENCE_FIELDS = [
    "changed", "order_id", "return_status", "request_id", "idempotent_replay", "status",
]
ELIGIBILITY_EVIDENCE_FIELDS = ["eligible", "reason", "days_since_delivery"]
TRANSITION_EVIDENCE_FIELDS = [
    "changed", "order_id", "user_id", "status", "return_status", "request_id",
    "idempotent_replay", "cancel_reason", "shipping_address", "item_ids",
    "product_id", "payment_method_id", "exchange_status", "address",
]

# --- conversation progress ----------------------------------------------
RETURN_INTENT_TERMS = ["退货", "退换", "return"]
AFFIRMATIVE = ["确认", "确认提交", "确认提交退货", "同意", "yes", "confirm"]
NEGATIVE = ["取消", "不确认", "不同意", "no"]
REASON_REFUSALS = [
    "不提供", "拒绝提供", "不想提供", "不愿提供", "不给",
    "不提供退货原因", "拒绝说明原因", "拒绝提供退货原因",
]
VERIFICATION_REFUSALS = [
    "不提供", "拒绝提供", "不想提供", "不愿提供", "不给",
    "拒绝提供验证码", "不愿提供验证码", "不想提供验证码", "拒绝验证",
]
REFUSAL_STRIP_PATTERN = r"[\s，。！？,.!?：:]"
REASON_REFUSAL_PATTERN = r"^(?:我)?(?:不愿|不想|拒绝|不|无法)(?:提供|说明|告知|透露|给)?(?:退货)?原因$"
CODE_REFUSAL_PATTERN = r"^(?:我)?(?:不愿|不想|拒绝|不|无法)(?:提供|给)?(?:六位)?验证码$"
STATED_REASON_PATTERN = r"(?i)(?:退货原因|原因)\s*[:：]\s*(.+)"
ORDER_ID_PATTERN = r"(?i)O[0-9]{6}"
CODE_IN_TEXT_PATTERN = r"(?<![A-Za-z0-9])[0-9]{6}(?![0-9])"
CODE_REQUEST_PHRASES = [
    "验证码", "验证代码", "校验码", "verification code", "six-digit code", "6-digit code",
    "six digit code", "6 digit code",
]
SIX_DIGIT_CODE_PATTERN = r"六位(?:的)?(?:验证|校验)?(?:代码|数字|码)"
REASON_REQUEST_PATTERNS = [
    r"(?:请|麻烦)?(?:提供|告知|告诉|说明).{0,16}(?:退货)?原因",
    r"(?:退货)?原因.{0,8}(?:是什么|为何|呢|吗|请说明|请提供)",
    r"(?i)(?:what|provide|tell|state).{0,24}(?:return )?reason",
]
ASK_USER_TEMPLATES = {
    "verification_code": "请提供用于身份验证的六位验证码。",
    "order_id": "请提供订单号。",
    "return_reason": "请提供退货原因。",
    "confirmation": "订单符合条件，是否确认提交退货？",
}
KNOWN_ACTION_KEYS = [
    "handoff", "final_answer",
    "get_order", "check_return_eligibility", "create_return_request",
    "cancel_pending_order", "modify_pending_order_address",
    "modify_pending_order_items", "modify_pending_order_payment",
    "modify_user_address", "return_delivered_order_items",
    "exchange_delivered_order_items",
    "ask_user:verification_code", "ask_user:order_id",
    "ask_user:return_reason", "ask_user:confirmation",
]
STEP_DONE_TEXT = "当前步骤已处理完毕。"
FAIL_CLOSED_TEXT = "无法在当前任务进度允许的动作集合内继续，已停止。"

# --- process audit -------------------------------------------------------
CONFIRMATION_PATTERN = (
    r"(?i)^\s*(yes|yes[,.! ]|yep|yeah|correct|confirmed|confirm|go ahead|"
    r"please (do|proceed|cancel|change|modify|return|exchange)|do it|proceed|"
    r"that'?s right|sounds good|好的|是的|确认|可以|请执行)"
)
CONFIRMATION_REQUEST_PATTERN = r"(?i)\b(confirm|confirmation|go ahead|proceed)\b|确认|是否执行"
REFUSAL_PATTERN = (
    r"(?i)\b(cannot|can't|unable|not allowed|not permitted|won't|will not)\b|不能|无法|不允许|拒绝"
)
NO_CHANGE_PATTERN = (
    r"(?i)\b(no change|not proceed|won't proceed|will not proceed|not cancelled|not modified)\b|"
    r"未更改|不会执行|没有修改|没有取消"
)
IDEMPOTENT_PATTERN = (
    r"(?i)\b(already|previously)\b.*\b(cancelled|completed|done|returned|exchanged)\b|"
    r"已经.*(取消|完成|退货|换货)"
)

# --- training records ----------------------------------------------------
ACCEPTED_TERMINATIONS = ["user_stop", "agent_stop"]
RECORD_ROLES = ["system", "user", "assistant", "tool_call", "tool_response"]
APPROVED_USAGE_RIGHTS = ["approved_open_weights", "approved_terms"]

# --- action envelope -----------------------------------------------------
ENVELOPE_FIELDS = ["action_type", "tool_name", "arguments", "content", "requires_user_response"]
FALLBACK_REASONS = ["model_action_parse_failure", "model_generation_error"]

# --- history compaction --------------------------------------------------
COMPACT_BASE_FIELDS = [
    "ok", "error", "changed", "eligible", "reason", "days_since_delivery",
    "request_id", "status", "return_status", "handoff_id", "idempotent_replay",
]
COMPACT_ORDER_FIELDS = [
    "order_id", "user_id", "status", "return_status", "delivered_at",
    "quality_issue", "opened", "cancel_reason", "return_items",
    "return_payment_method_id", "request_id", "changed", "idempotent_replay",
]
COMPACT_ITEM_FIELDS = ["item_id", "product_id", "name", "title", "price", "options", "available"]
COMPACT_PAYMENT_FIELDS = ["transaction_type", "amount", "payment_method_id"]
COMPACT_FULFILLMENT_FIELDS = ["tracking_id", "item_ids"]
COMPACT_PRODUCT_FIELDS = [
    "product_id", "item_id", "title", "name", "category", "price", "inventory", "options", "available",
]

# --- write-gate probes ---------------------------------------------------
PROBE_INTENTS = [
    ("cancel_pending_order", "pending", "取消待处理订单"),
    ("modify_pending_order_address", "pending", "修改待处理订单的收货地址"),
    ("modify_pending_order_items", "pending", "修改待处理订单里的商品"),
    ("modify_pending_order_payment", "pending", "修改待处理订单的支付方式"),
    ("create_return_request", "delivered", "为已签收订单申请退货"),
    ("return_delivered_order_items", "delivered", "退回已签收订单中的商品"),
    ("exchange_delivered_order_items", "delivered", "换货已签收订单中的商品"),
]
PROBE_TEMPLATES = {
    "verification_code": [
        "请帮我{intent}，订单号 {order_id}。",
        "订单 {order_id} 需要{intent}，按政策处理即可。",
        "我是订单 {order_id} 的用户，想{intent}。",
        "帮我处理订单 {order_id}：{intent}。",
    ],
    "confirmation": [
        "我的验证码是 {code}。请帮我{intent}，订单号 {order_id}。",
        "订单 {order_id} 需要{intent}。验证码 {code}。",
        "验证码 {code}，我是订单 {order_id} 的用户，想{intent}。",
        "帮我处理订单 {order_id}：{intent}。身份验证码：{code}。",
    ],
}
PROBE_SEED = 20260814
PROBE_CODE = "123456"
MIN_PROBES_PER_CLASS = 20

# --- generated benchmarks ------------------------------------------------
#: What a product without category aliases is called in a generated question.
NO_ALIAS = "商品"
