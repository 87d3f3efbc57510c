"""Message, prompt and script texts that downstream consumers compare or parse word for word."""

EXECUTION_TIMEOUT_MS = 30_000

# --- error messages ----------------------------------------------------------------------------------------------

NAVIGATION_ERROR = "Navigation timeout: page did not load within {ms}ms"
LOCATOR_ERROR = "Timeout: element not found or not visible: {locator}"
TIMEOUT_ERROR = "Timeout: {message}"
ASSERTION_ERROR = "Assertion failed: {message}"
STRICT_ERROR = "Strict mode violation: selector matched multiple elements"
CRASH_ERROR = "Execution crashed: {message}"
NOT_FOUND_ERROR = "Element not found with any strategy:\n{failures}"

# --- error contexts ----------------------------------------------------------------------------------------------

NAVIGATION_CONTEXT = """Navigation failed. Possible causes:
- Server not responding
- Network issues
- Page stuck loading resources
- Invalid URL: {url}"""

TIMEOUT_CONTEXT = """Element interaction timed out.

Likely causes:
1. Element doesn't exist on page (selector mismatch)
2. Element exists but is hidden/covered by another element
3. Page structure changed since test was generated
4. JavaScript is still running and element not yet attached

Debug info:
- Page URL: {url}
- Page size: {page_size} bytes
- Errors on page: {errors}
- Failed requests: {failed_requests}

{first_error}
"""

ASSERTION_CONTEXT = """A test assertion did not pass.

Assertion: {message}

This means the actual result did not match what the test expected.
Check if:
- Application behavior changed
- Page redirected to unexpected location
- Expected text/element not present
"""

STRICT_CONTEXT = """The selector is ambiguous and matches 2+ elements.

Error: {message}

Solution: Use more specific selector (prefer ID over text, prefer data-testid over class)
"""

GENERIC_CONTEXT = """{error_type}: {message}

Traceback (last 500 chars):
{traceback}
"""

CRASH_CONTEXT = """Test execution crashed before completion.

Error: {message}

Traceback:
{traceback}

This could indicate:
- Browser launch failure
- Invalid test script syntax
- Missing dependencies
- System resource issues
"""

# --- script request ----------------------------------------------------------------------------------------------

RETRY_CONTEXT = """
=== SELF-HEALING MODE: PREVIOUS ATTEMPT FAILED ===

Previous Attempt: {attempt_number}

ERROR MESSAGE:
{previous_error}

ERROR DETAILS:
{previous_error_context}

CONSOLE ERRORS CAPTURED:
{console_errors}

WHAT THIS MEANS:
1. The selector strategy from the previous attempt didn't work
2. The element we were looking for might exist but needs a different approach
3. Look at the ACTUAL DOM below and use EXACT IDs/names/text from it
4. Try a different selector strategy (ID → name → label → text → role)
5. Include fallback selectors in the script

ACTUAL PAGE STRUCTURE TO USE (extract exact selectors from this):
"""

RETRY_INSTRUCTIONS = """
=== IMPORTANT FOR THIS RETRY ===
- DO NOT use the same selector that failed last time
- Match EXACT text values from the DOM above
- Use multi-strategy approach with fallbacks
- If an element shows id="xyz", use page.locator("#xyz")
- If an element shows name="email", use page.locator('input[name="email"]')
- Always include try/except for timeouts with helpful error messages
"""

SCRIPT_PROMPT = """
=== TARGET APPLICATION ===
URL: {url}
Page Title: {page_title}
Viewport: {width}x{height}
Is Retry: {is_retry}
Attempt: {attempt}/3

=== TEST INTENT ===
{prompt}

=== PROJECT CONTEXT (from requirements) ===
{context_block}

{retry_context}

=== ACTUAL PAGE STRUCTURE (THIS IS THE GROUND TRUTH) ===
{page_structure}

{retry_instructions}

Now generate the Playwright test script body.
Make sure to:
1. Use EXACT selectors from the DOM structure shown above
2. Include fallback strategies for critical elements
3. Add clear error messages for debugging
4. Keep selectors specific and unambiguous
"""

FALLBACK_SCRIPT = """
# Fallback script - LLM call failed
try:
    page.goto("{url}")
    page.wait_for_load_state("load")
    assert page.url == "{url}" or "{url}" in page.url
    print("Basic navigation test passed")
except Exception as e:
    print(f"Fallback script failed: {{e}}")
    raise
"""

# --- review requests ---------------------------------------------------------------------------------------------

ANALYSIS_PROMPT = """Test failures detected:
{failure_details}

Visual issues: {visual_issues} found

Provide a short root cause analysis for a developer:
1) Most likely root cause (be specific)
2) Severity: critical, warning, or info
3) A concrete, actionable recommendation
4) Which page element or interaction failed"""

VISUAL_PROMPT = """
URL: {page_url}
Visual Difference: {difference_percent}%

Is this a real bug or expected design change?
(Respond with classification: real_bug / expected_update / environmental)
"""

# --- defaults ----------------------------------------------------------------------------------------------------

NO_PAGE_STRUCTURE = "(could not fetch page structure)"
UNKNOWN_TITLE = "Unknown"
VIEWPORT_WIDTH = 1920
VIEWPORT_HEIGHT = 1080
CLEAN_RECOMMENDATION = "No issues detected. All checks passed."
REPORT_RECOMMENDATION = "All checks passed successfully."
