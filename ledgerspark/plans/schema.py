"""Field schemas of the labelled-line reader as a DataFrame dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Per document type, each field with its names in order of precedence, its type, whether it
# is required, and its category.
BALANCE_SHEET = [
    ("total_assets", ["total assets", "assets total", "total asset"], "number", True, "Assets"),
    ("current_assets", ["current assets", "total current assets"], "number", True, "Assets"),
    ("non_current_assets", ["non-current assets", "non current assets", "total non-current assets", "total non current assets"], "number", False, "Assets"),
    ("cash_and_equivalents", ["cash and cash equivalents", "cash & cash equivalents", "cash and bank balances", "cash & bank", "cash"], "number", False, "Assets"),
    ("trade_receivables", ["trade receivables", "accounts receivable", "sundry debtors", "debtors"], "number", False, "Assets"),
    ("inventories", ["inventories", "inventory", "stock-in-trade", "stock in trade"], "number", False, "Assets"),
    ("fixed_assets", ["fixed assets", "property plant and equipment", "property, plant and equipment", "ppe", "tangible assets", "net fixed assets", "total fixed assets"], "number", False, "Assets"),
    ("intangible_assets", ["intangible assets", "goodwill", "goodwill and intangible assets"], "number", False, "Assets"),
    ("investments", ["investments", "total investments", "non-current investments", "current investments"], "number", False, "Assets"),
    ("other_assets", ["other assets", "other current assets", "other non-current assets"], "number", False, "Assets"),
    ("loans_and_advances", ["loans and advances", "loans & advances", "short term loans and advances", "long term loans and advances"], "number", False, "Assets"),
    ("total_liabilities", ["total liabilities", "liabilities total"], "number", True, "Liabilities"),
    ("current_liabilities", ["current liabilities", "total current liabilities"], "number", True, "Liabilities"),
    ("non_current_liabilities", ["non-current liabilities", "non current liabilities", "total non-current liabilities", "long term liabilities"], "number", False, "Liabilities"),
    ("trade_payables", ["trade payables", "accounts payable", "sundry creditors", "creditors"], "number", False, "Liabilities"),
    ("borrowings", ["borrowings", "total borrowings", "short term borrowings", "long term borrowings", "debt", "total debt"], "number", False, "Liabilities"),
    ("provisions", ["provisions", "total provisions"], "number", False, "Liabilities"),
    ("other_liabilities", ["other liabilities", "other current liabilities", "other non-current liabilities"], "number", False, "Liabilities"),
    ("shareholders_equity", ["shareholders equity", "shareholder's equity", "shareholders' equity", "total equity", "equity", "net worth", "total shareholders funds", "shareholders' funds"], "number", True, "Equity"),
    ("share_capital", ["share capital", "equity share capital", "paid-up capital", "paid up capital", "issued capital"], "number", False, "Equity"),
    ("reserves_and_surplus", ["reserves and surplus", "reserves & surplus", "retained earnings", "other equity"], "number", False, "Equity"),
    ("minority_interest", ["minority interest", "non-controlling interest", "non controlling interest"], "number", False, "Equity"),
    ("total_equity_and_liabilities", ["total equity and liabilities", "total liabilities and equity", "total liabilities & equity"], "number", False, "Totals"),
]
INCOME_STATEMENT = [
    ("revenue", ["revenue", "revenue from operations", "total revenue", "net revenue", "total income", "income from operations", "net sales", "sales", "turnover", "gross revenue"], "number", True, "Revenue"),
    ("other_income", ["other income", "other operating income", "non-operating income"], "number", False, "Revenue"),
    ("cost_of_goods_sold", ["cost of goods sold", "cogs", "cost of revenue", "cost of sales", "cost of materials consumed", "material costs"], "number", False, "Expenses"),
    ("total_expenses", ["total expenses", "total expenditure"], "number", False, "Expenses"),
    ("employee_expenses", ["employee benefit expense", "employee expenses", "employee costs", "staff costs", "personnel expenses", "salaries and wages"], "number", False, "Expenses"),
    ("depreciation", ["depreciation", "depreciation and amortisation", "depreciation and amortization", "depreciation & amortisation", "d&a"], "number", False, "Expenses"),
    ("finance_costs", ["finance costs", "finance cost", "interest expense", "interest cost", "interest and finance charges"], "number", False, "Expenses"),
    ("other_expenses", ["other expenses", "other expenditure", "selling and administrative expenses", "sg&a", "sga"], "number", False, "Expenses"),
    ("gross_profit", ["gross profit", "gross margin"], "number", False, "Profitability"),
    ("operating_profit", ["operating profit", "operating income", "ebit", "profit from operations"], "number", False, "Profitability"),
    ("ebitda", ["ebitda", "earnings before interest tax depreciation and amortization"], "number", False, "Profitability"),
    ("profit_before_tax", ["profit before tax", "pbt", "income before tax", "earnings before tax", "profit before taxation"], "number", True, "Profitability"),
    ("tax_expense", ["tax expense", "income tax expense", "tax", "provision for tax", "income tax"], "number", False, "Profitability"),
    ("net_profit", ["net profit", "net income", "profit after tax", "pat", "profit for the period", "profit for the year", "net profit after tax", "profit/(loss) for the period"], "number", True, "Profitability"),
    ("eps_basic", ["basic eps", "earnings per share basic", "earnings per share - basic", "eps (basic)"], "number", False, "Per Share"),
    ("eps_diluted", ["diluted eps", "earnings per share diluted", "earnings per share - diluted", "eps (diluted)"], "number", False, "Per Share"),
]
CASH_FLOW_STATEMENT = [
    ("cash_from_operations", ["cash from operating activities", "net cash from operating activities", "cash flow from operating activities", "operating cash flow", "cash generated from operations", "net cash generated from operating activities", "cfo"], "number", True, "Operating Activities"),
    ("profit_before_tax", ["profit before tax", "pbt", "net profit before tax"], "number", False, "Operating Activities"),
    ("depreciation_cf", ["depreciation", "depreciation and amortisation", "depreciation and amortization"], "number", False, "Operating Activities"),
    ("working_capital_changes", ["working capital changes", "changes in working capital", "adjustments for changes in working capital"], "number", False, "Operating Activities"),
    ("tax_paid", ["income tax paid", "tax paid", "taxes paid"], "number", False, "Operating Activities"),
    ("cash_from_investing", ["cash from investing activities", "net cash from investing activities", "cash flow from investing activities", "investing cash flow", "net cash used in investing activities", "cfi"], "number", True, "Investing Activities"),
    ("capex", ["capital expenditure", "capex", "purchase of fixed assets", "purchase of property plant and equipment", "purchase of ppe", "acquisition of fixed assets"], "number", False, "Investing Activities"),
    ("investment_purchases", ["purchase of investments", "investments purchased"], "number", False, "Investing Activities"),
    ("investment_sales", ["sale of investments", "proceeds from sale of investments", "investments sold"], "number", False, "Investing Activities"),
    ("cash_from_financing", ["cash from financing activities", "net cash from financing activities", "cash flow from financing activities", "financing cash flow", "net cash used in financing activities", "cff"], "number", True, "Financing Activities"),
    ("dividends_paid", ["dividends paid", "dividend paid", "payment of dividends"], "number", False, "Financing Activities"),
    ("borrowings_raised", ["proceeds from borrowings", "borrowings raised", "proceeds from long term borrowings", "proceeds from short term borrowings"], "number", False, "Financing Activities"),
    ("borrowings_repaid", ["repayment of borrowings", "borrowings repaid", "repayment of long term borrowings", "repayment of short term borrowings"], "number", False, "Financing Activities"),
    ("interest_paid", ["interest paid", "finance costs paid"], "number", False, "Financing Activities"),
    ("net_change_in_cash", ["net increase in cash", "net decrease in cash", "net change in cash", "net increase/(decrease) in cash", "net increase/decrease in cash and cash equivalents"], "number", True, "Net Change"),
    ("opening_cash", ["opening cash", "cash at beginning", "cash and cash equivalents at beginning", "opening balance"], "number", False, "Net Change"),
    ("closing_cash", ["closing cash", "cash at end", "cash and cash equivalents at end", "closing balance"], "number", False, "Net Change"),
]
INVOICE = [
    ("invoice_number", ["invoice number", "invoice no", "invoice #", "invoice id"], "string", False, "Identity"),
    ("invoice_date", ["invoice date", "date issued", "issue date"], "date", False, "Identity"),
    ("vendor", ["vendor", "seller", "from", "supplier"], "string", False, "Parties"),
    ("customer", ["customer", "buyer", "bill to", "client"], "string", False, "Parties"),
    ("subtotal", ["subtotal", "sub total", "amount before tax"], "number", True, "Totals"),
    ("tax_amount", ["tax", "sales tax", "vat", "gst", "tax amount"], "number", False, "Totals"),
    ("shipping_and_handling", ["shipping", "shipping & handling", "shipping and handling", "delivery"], "number", False, "Totals"),
    ("discount", ["discount", "less discount"], "number", False, "Totals"),
    ("total_amount", ["total due", "amount due", "grand total", "invoice total", "total"], "number", True, "Totals"),
]
TYPES = {"Balance Sheet": BALANCE_SHEET, "Income Statement": INCOME_STATEMENT, "Cash Flow Statement": CASH_FLOW_STATEMENT, "Invoice": INVOICE}

ALIASES = "schema_type string, field_ord int, field string, alias_ord int, alias string, type string, required boolean, category string"


def field_aliases(spark: SparkSession) -> DataFrame:
    """One row per name of each field. Users extend the reader by adding rows."""
    rows = [(t, i, name, j, alias, kind, required, category) for t, fields in TYPES.items() for i, (name, aliases, kind, required, category) in enumerate(fields) for j, alias in enumerate(aliases)]
    return spark.createDataFrame(rows, ALIASES)


def requested(aliases: DataFrame, names: list[str]) -> DataFrame:
    """The rows of fields that one of the names means, as a field's name or alias, in any case; all rows for no names."""
    if not names:
        return aliases
    low = aliases.sparkSession.createDataFrame([(n.strip().lower(),) for n in names], "name string")
    from pyspark.sql import functions as F

    hit = aliases.join(low, (F.lower("field") == F.col("name")) | (F.lower("alias") == F.col("name")), "left_semi").select("schema_type", "field").distinct()
    return aliases.join(hit, ["schema_type", "field"], "left_semi").select(*aliases.columns)


def template(aliases: DataFrame) -> DataFrame:
    """Per type: the fields in order, how many there are and are required, and the categories."""
    from pyspark.sql import functions as F

    fields = aliases.where("alias_ord = 0")
    names = F.transform(F.array_sort(F.collect_list(F.struct("field_ord", "field"))), lambda x: x["field"])
    return fields.groupBy("schema_type").agg(names.alias("fields"), F.count("*").alias("total_fields"), F.count_if("required").alias("required_fields"), F.array_sort(F.collect_set("category")).alias("categories"))
